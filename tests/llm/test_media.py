import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import media_columns as M


def test_round_trips():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (7, 64), (20, 13)):
        a = rng.integers(0, 256, (h, w), np.uint8)
        assert (M.decode(M.encode_pgm(a)) == a).all()
        assert (M.decode(M.encode_bmp(a)) == a).all()


def test_other_netpbm_kinds():
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert M.decode(b"P2\n2 1\n15\n0 15\n").tolist() == [[0, 255]]
    assert M.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]


def test_bmp_24_bits():
    row = bytes([1, 2, 3, 4, 5, 6, 0, 0])
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little")
    assert M.decode(head + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + row).tolist() == [[[3, 2, 1], [6, 5, 4]]]


def test_area_resize_is_exact_mean():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (7, 11)).astype(float)
    big = np.kron(a, np.ones((3, 4)))  # 21 x 44: pixel areas as samples
    want = big.reshape(3, 7, 4, 11).mean(axis=(1, 3))
    assert np.allclose(M.area_resize(a, 3, 4), want)
    assert np.allclose(M.area_resize(a, 7, 11), a)


def test_damaged_media_are_null(spark):
    df = spark.createDataFrame([(1, b"P5\n2 2\n255\nab"), (2, None), (3, b"nonsense"), (4, M.encode_pgm(np.zeros((2, 2), np.uint8)))], "media_id long, data binary")
    got = {r.media_id: r.dhash for r in M.tiles(df).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "0" * 16}


@pytest.mark.parametrize(
    "data",
    [b"P5 0 0\n255\n", b"P2 1 1\n255\n99999999999999999999999", b"P2 1 1\n0\n0", b"P2 1 1\n70000\n1", b"P1 2 1\n1x", b"P2 1 1\n9\n12", b"P6 99999999 99999999\n255\nx",
     b"BM" + bytes(60), b"P5", b"P4 8 9\n1"],
)
def test_media_that_cannot_be_decoded(spark, data):
    row = M.tiles(spark.createDataFrame([(1, bytearray(data))], "media_id long, data binary")).first()
    assert row.media_id == 1 and row.tile is None and row.dhash is None and row.height is None


def test_tile_is_npy(spark):
    import io

    t = np.load(io.BytesIO(M.tile(np.full((30, 40), 9, np.uint8))))
    assert t.shape == M.TILE and (t == 9).all()


@pytest.mark.parametrize("text", [None, "", "é" * 40, "x" * 64, "x" * 65])
def test_store(text):
    media, n = M.store(text)
    data = (text or "").encode()
    payload = data + bytes((-len(data) % 64) if data else 64)
    got = M.digest(media)
    assert n == len(data) and got[:3] == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3:5] == (len(media), hashlib.sha256(media).hexdigest())


def test_table(odd, empty):
    assert M.text_media(odd).count() == odd.count() and M.text_media(empty).count() == 0
