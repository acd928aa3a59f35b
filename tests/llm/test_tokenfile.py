"""The range coder and token files: exact round trips, checksums, starts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import coder, tokenfile, tokens


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=300), st.integers(0, 2**32 - 1))
def test_round_trip(ids, odd):
    x = np.array([*ids, odd, odd], np.uint32)
    got, lengths, keys = coder.decode(coder.encode(x, np.array([len(x), 0]), [None, -7]))
    assert got.tolist() == x.tolist() and lengths.tolist() == [len(x), 0] and keys == [None, -7]


def test_many_blocks_and_compression():
    rng = np.random.default_rng(2)
    x = np.minimum(rng.zipf(1.3, 3 * coder.BLOCK + 17), 49_000).astype(np.uint32)
    frame = coder.encode(x, np.array([len(x)]), [2**62])
    got, _, keys = coder.decode(frame)
    assert (got == x).all() and keys == [2**62] and len(frame) < 1.5 * len(x)
    repeated = np.tile(np.arange(50, dtype=np.uint32), 200)
    assert len(coder.encode(repeated, np.array([10_000]), [1])) < 1200
    every = np.arange(coder.BLOCK, dtype=np.uint32) * 11
    assert (coder.decode(coder.encode(every, np.array([len(every)]), [1]))[0] == every).all()


def test_corruption_is_found():
    frame = bytearray(coder.encode(np.arange(500, dtype=np.uint32) % 37, np.array([500]), [1]))
    frame[-20] ^= 4
    with pytest.raises(coder.CorruptBlock):
        coder.decode(bytes(frame))


def test_empty_frame():
    ids, lengths, keys = coder.decode(coder.encode(np.zeros(0, np.uint32), np.zeros(0, np.int64), []))
    assert len(ids) == len(lengths) == len(keys) == 0


def test_query_rows(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME", 3000)
    texts = [(7 * i % 61, "some words " * (i * 13 % 300), "x") for i in range(61)] + [(100, None, ""), (101, "", ""), (None, "null id", ""), (5, "again", "")]
    df = spark.createDataFrame(texts, "doc_id long, text string, start string")
    rows = tokenfile.round_trip(df).collect()
    plain = Tokenizer.from_file(tokens.default_path())
    encoded = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    want = sorted((-1 if k is None else k, len(encoded(t)), zlib.crc32(np.array(encoded(t), "<u4").tobytes())) for k, t, _ in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [-1 if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == sorted(ordered)
    assert tokenfile.round_trip(df.limit(0)).collect() == []
