import pytest

#: Ties, repeats, nulls, empties, other scripts, blanks, special strings and one very long text.
ODD = [
    None,
    "",
    " \n\t ",
    "a",
    "Re.",
    "one two three four",
    "one two three four five",
    "one two three four five",
    "ONE two\nthree  four\tfive",
    "été ñandú straße ÉTÉ",
    "漢字かな 한국어 ελληνικά Σ İ ﬁ",
    "!!! ??? --- 123 456",
    "<|endoftext|> and <|startoftext|> inside",
    "\x00\x01\x1c\x85\xa0end",
    "under the mit license and Apache License, Version 2.0; CC BY-NC 4.0",
    "the quick brown fox jumps over the lazy dog " * 3000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with clashing extra columns; the last row has no doc_id and the first two ids repeat a row."""
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 7, "k") for i, t in enumerate(ODD)]
    rows += [rows[6], (None, "no id here at all", "fr", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
