"""Multiple-instance toxicity: ranking on held-out rows, located sentences, edge cases."""

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import toxicity


def documents(spark):
    rng = np.random.default_rng(4)
    words = [a + b for a in "bcdfghlmnprstv" for b in ("a", "en", "ir", "osto", "ula")]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(words, 9)) for _ in range(6)]
        bad = i % 6 == 0
        if bad:
            sentences[i // 6 % 6] += " grumblor" + rng.choice(["s", "ed", "ing"])
        rows.append((i, ". ".join(sentences) + ".", "clash"))
        labels.append((i, int(bad), 0.5))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text double")


def test_held_out_and_location(spark):
    docs, labels = documents(spark)
    rows = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    assert len(rows) == 600
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held) / len(held) > 0.97
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, r in rows.items():
        if k % 6 == 0 and r["predicted"]:
            assert any("grumblor" in texts[k].encode()[s["start"] : s["stop"]].decode() for s in r["offending"])


def test_noisy_or_against_products():
    p, first = np.array([0.1, 0.5, 0.9, 0.2]), np.array([0, 2, 2, 4])
    assert toxicity.noisy_or(p, first) == pytest.approx([1 - 0.9 * 0.5, 0, 1 - 0.1 * 0.8])


def test_sentences():
    x = toxicity.instances(pa.array(["One two. Three!\nfour", None, "", "...", "five"]))
    assert x.first.tolist() == [0, 3, 3, 3, 3, 4] and x.begin.tolist() == [0, 9, 16, 0] and x.stop.tolist() == [7, 14, 20, 4]


def test_edge_rows(spark):
    docs, labels = documents(spark)
    odd = spark.createDataFrame([(None, "grumblors here", ""), (900, None, ""), (901, "", ""), (902, "x " * 400_000, ""), (0, "again", "")], docs.schema)
    extra = spark.createDataFrame([(900, None, 0.1), (None, 1, 0.1), (902, 7, 0.2)], labels.schema)
    got = toxicity.judge(docs.union(odd), labels.union(extra)).collect()
    assert len(got) == 605 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.judge(docs.limit(0), labels).collect() == []
    assert all(r["score"] < 1e-6 for r in toxicity.judge(docs, labels.limit(0)).collect())
