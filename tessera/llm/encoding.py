"""Token ids of texts, equal to the tokenizers library's on every text.

Both JSON tokenizers split a text into pre-tokens with a fixed pattern and encode each by itself.  Merges
of lowest rank first depend on the bytes alone, so a table of ranks by bytes gives the same ids; tiktoken
applies such a table faster.  Texts made only of characters on which every engine surely splits alike
take that way; the rest (other scripts, control characters, special strings) go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

#: Characters for which class membership is the same in every engine: printable ASCII, tab, newline,
#: carriage return and Latin-1 letters and signs, without the superscripts, fractions and ordinals.
UNSURE = re.compile("[^\t\n\r -~¡-©«¬®-±´¶-¸»¿-ÿ]")
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
BYTE_LEVEL = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\t\n\r 0-9{LETTER}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)
WORD_END = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\t\n\r 0-9{LETTER}]+")
#: The same splits for tiktoken's engine.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Strings that a worker remembers; beyond, it starts afresh.  About 150 bytes each.
REMEMBERED = 200_000
#: Longer strings aren't remembered, so what a worker holds is bounded.
LONGEST = 64
#: Stands for a word's end; texts with this character go through the library.
END = "\0"

_open: dict = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file by name; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The library's tokenizer, opened once per worker."""
    if name not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _open[name] = Tokenizer.from_file(tokenizer_path(name))
    return _open[name]


class Remembering(dict):
    """A dictionary that computes what it misses and forgets everything at a bound; long keys aren't kept."""

    def __init__(self, compute: Callable, most: int = REMEMBERED):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if not isinstance(key, str) or len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def byte_letters() -> dict[str, int]:
    """Byte-level letters to bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def model_of(name: str) -> dict:
    with open(tokenizer_path(name), encoding="utf-8") as f:
        return json.load(f)["model"]


def ranks_of(model: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """Ranks by bytes, single bytes and word ends first, then merges in their order; and the id of each rank."""
    letters, vocab = byte_letters(), model["vocab"]
    suffix = model.get("end_of_word_suffix") or ""
    made = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
    single = [*letters, *(c + suffix for c in letters if suffix)]

    def as_bytes(token: str) -> bytes:
        whole = bool(suffix) and token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if whole else token)) + (END.encode() if whole else b"")

    ranks, ids = {}, []
    for token in [*single, *made]:
        ranks[as_bytes(token)] = len(ids)
        ids.append(vocab[token])
    if len(ranks) < len(ids):
        raise ValueError("two tokens have the same bytes")
    return ranks, np.array(ids)


class IdEncoder:
    """``encode(text)``: the text's ids as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, name: str, width: int = 4):
        import tiktoken

        self.tok = load(name)
        self.kind = np.dtype(f"<u{width}")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.lower = self.tok.normalizer is not None
        ranks, ids = ranks_of(model_of(name))
        self.ids = ids.astype(self.kind)
        pattern = f"[^{END}]+{END}" if self.lower else PATTERN
        self.table = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if UNSURE.search(text) or ("<|" in text and any(s in text for s in self.special)):
            return self._library(text)
        if self.lower:
            words = WORD_END.findall(text.lower())
            text = END.join([*words, ""])
        return self.ids[self.table.encode_ordinary(text)].tobytes() if text else b""


def encoder(name: str, width: int = 4) -> IdEncoder:
    """One encoder per worker and tokenizer."""
    key = (name, width)
    if key not in _open:
        _open[key] = IdEncoder(name, width)
    return _open[key]
