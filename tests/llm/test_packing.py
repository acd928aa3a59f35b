"""Packing: whole pieces, gapless bins, few bins, and encoding piece by piece."""

import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import packing, tokens


def test_encoder_equals_whole_text_encoding():
    path = tokens.default_path()
    plain = Tokenizer.from_file(path)
    texts = ["", "Hello  world's\n\tit's 12,345 éÀ ß…", "a\x1cb c d  é x", "<|endoftext|> q<|startoftext|>", "日本語 テスト 　 x", "don't 'S \"quoted\""]
    texts += ["ÀÉ Straße", " lead", "trail \n", "İstanbul ŉ ǅ", "x" * 70_000, "a\u2028b\u00a0c", "DON'T 5th it's."]
    ids, at = tokens.Encoder(path)(pa.array([None, *texts])[1:])
    for k, text in enumerate(texts):
        want = plain.encode(text, add_special_tokens=False).ids + [1]
        assert ids[at[k] : at[k + 1]].tolist() == want, text
    assert tokens.Encoder(path)(pa.array([None], pa.string()))[0].tolist() == [1]


def least_bins(lengths, capacity):
    """The fewest bins, by trying all."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, (*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]))
        place(i + 1, (*bins, lengths[i]))

    place(0, ())
    return best


def test_against_the_optimum():
    rng, over = random.Random(4), 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        over += len(packing.pack_group(lengths, 24)) - least_bins(lengths, 24)
    assert over == 0


def test_best_exchange_against_all():
    rng = np.random.default_rng(6)
    for _ in range(200):
        low = np.sort(rng.integers(1, 30, rng.integers(1, 7)))
        high = np.concatenate([[0], rng.integers(1, 30, 8)])
        room, lead = rng.integers(0, 25, 9), rng.integers(-3, 9, 9)
        moves = [(a,) for a in low] + [(low[i], low[j]) for i in range(len(low)) for j in range(i + 1, len(low))]
        want = max([sum(m) - b for m in moves for b, r, d in zip(high, room, lead, strict=True) if d >= 0 and 0 < sum(m) - b <= r], default=0)
        got = packing._best_exchange(low, high, room, lead)
        assert (got[3] if got else 0) == want
        if got:
            i, j, k, gain = got
            assert low[i] + (low[j] if j >= 0 else 0) - high[k] == gain and i != j


def test_a_group_without_gain_ends(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    df = spark.range(100).selectExpr("id", "cast(60 as bigint) as length")
    assert packing.pack(df, 100).select("sequence_id").distinct().count() == 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_bins_hold_every_piece_once(lengths):
    bins = packing.pack_group(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)


def test_close_to_the_bound():
    rng = random.Random(3)
    lengths = [min(4096, 1 + int(rng.lognormvariate(6.5, 1))) for _ in range(4000)]
    bins = packing.pack_group(lengths, 4096)
    assert len(bins) <= -(-sum(lengths) // 4096) + 2


def test_swap_search_beats_best_fit():
    lengths = [6, 5, 5, 4, 3, 3, 2, 2]
    fitted = packing.best_fit(lengths, 10)
    assert len(packing.local_search(fitted, lengths, 10)) <= len(fitted) and len(packing.pack_group(lengths, 10)) == 3


def test_query_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 16)
    texts = [(i, "word " * (37 * i % 900), "clash") for i in range(30)] + [(30, None, ""), (31, "long text " * 5000, ""), (3, "word", ""), (None, "x", "")]
    df = spark.createDataFrame(texts, "doc_id long, text string, sequence_id string")
    rows = packing.pack_documents(df).collect()
    plain = Tokenizer.from_file(tokens.default_path())
    want = []
    for k, text, _ in texts:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            want.append((k, p, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1
    assert packing.pack_documents(df.limit(0)).collect() == []
