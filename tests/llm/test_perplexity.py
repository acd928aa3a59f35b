"""Cross-entropy difference against a dictionary computation."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import perplexity as lm

TEXTS = {1: "The cat sat, on 12 mats.\nIt purred.", 2: "café é ß über", 3: "", 4: None, 5: "zz zz zz zz!", 6: "the cat sat again. the cat", 7: "zz zz the cat", 8: "..."}
GOOD = {1, 6}


def tokens(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def grams(text):
    own = tokens(text)
    return Counter(own) + Counter(zip(["<s>", *own[:-1]], own, strict=True) if own else []) + Counter(["<s>"] if own else [])


def losses(rows, good):
    """rows: (key, id, text)"""
    out = {}
    for key, k, text in rows:
        own = tokens(text)
        found = []
        for target in (True, False):
            others = [t for other, i, t in rows if (i in good) == target and other != key]
            count = sum((grams(t) for t in others), Counter())
            n, loss = sum(len(tokens(t)) for t in others), 0.0
            for h, w in zip(["<s>", *own[:-1]], own, strict=True) if own else []:
                p = (count[w] + lm.PRIOR / lm.VOCABULARY) / (n + lm.PRIOR)
                loss -= math.log((count[h, w] + lm.PRIOR * p) / (count[h] + lm.PRIOR))
            found.append(loss / len(own) if own else None)
        out[key] = (len(own), *found)
    return out


@pytest.mark.parametrize("block", [1 << 23, 40])
def test_against_dictionaries(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "PART", 1 << 22 if block > 100 else 10)
    docs = spark.createDataFrame([(k, t, 1) for k, t in TEXTS.items()], "doc_id long, text string, difference int")
    labels = spark.createDataFrame([(k, int(k in GOOD)) for k in TEXTS] + [(1, 1), (None, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, labels).collect()}
    want = losses([(k, k, t) for k, t in TEXTS.items()], GOOD)
    assert set(rows) == set(TEXTS)
    for k, (n, target, background) in want.items():
        assert rows[k]["n_tokens"] == n
        if not n:
            assert rows[k]["difference"] is None
            continue
        assert rows[k]["target_loss"] == pytest.approx(target) and rows[k]["background_loss"] == pytest.approx(background)
        assert rows[k]["difference"] == pytest.approx(target - background)


def test_documents_that_occur_twice_stand_apart(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfgl") + rng.choice("aeio") for _ in range(3))
    texts = {i: " ".join(word() for _ in range(80)) for i in range(60)}
    texts |= {100 + i: texts[i] for i in range(5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in range(20, 40))) for k in texts], "doc_id long, quality int")
    got = {r["doc_id"]: r["difference"] for r in lm.cross_entropy_difference(docs, labels).collect()}
    assert min(got[i] for i in range(5)) > max(got[i] for i in range(5, 60))


def test_packing_of_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 1000, 30_000):
        grams = np.unique(rng.integers(0, 1 << 56, n).astype(np.uint64))
        grams = np.unique(np.concatenate([grams, grams[:3] + np.uint64(1)]))
        counts = rng.integers(0, 300, len(grams)), rng.integers(0, 2, len(grams))
        got = lm.unpack(lm.pack(grams, counts))
        assert all((a == b).all() for a, b in zip(got, (grams, *counts), strict=True))


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert lm.cross_entropy_difference(docs, labels).collect() == []
    rows = [(None, "x y"), (None, "x y"), (3, "y z"), (3, "y z"), (4, "long text " * 60_000)]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.cross_entropy_difference(one, spark.createDataFrame([(3, 1)], "doc_id long, quality int")).collect()
    want = losses([(k, i, t) for k, (i, t) in enumerate(rows)], {3})
    assert sorted((r["n_tokens"], round(r["difference"], 9)) for r in got) == sorted((n, round(a - b, 9)) for n, a, b in want.values())
