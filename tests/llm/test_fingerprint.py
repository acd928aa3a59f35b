"""Fingerprints against a direct computation on a small table."""

import hashlib

from pyspark.sql import functions as F

from pathloom.llm import fingerprint as fp

TEXTS = {1: "one two three four\nfive six", 2: "", 5: None, 7: "é" * 9 + " x y z", 9: "five six\none two three four"}


def rows(spark, texts):
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, n_chars string")
    return {r["doc_id"]: r for r in fp.edited_fingerprints(df).collect()}


def test_edited_texts_and_order(spark):
    got = rows(spark, TEXTS)
    ids = sorted(TEXTS)
    assert sorted(got) == ids
    for i, k in enumerate(ids):
        text, after = TEXTS[k] or "", TEXTS[ids[(i + 1) % len(ids)]] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert got[k]["n_chars"] == len(text)
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[9]["fingerprint"]
    assert got[2]["fingerprint"] == got[5]["fingerprint"] == got[2]["edited_fingerprint"]
    assert got[9]["near_next"] == 1.0


def test_insertion_and_deletion(spark):
    df = spark.createDataFrame([(0, "a b c d"), (1, "e f"), (2, "a b c d\ne f"), (3, "e f\na b c d")], "k int, text string")
    by = {r["k"]: r["fingerprint"] for r in fp.fingerprint_documents(df, ["k"]).collect()}
    assert by[2] == by[3]
    one = spark.createDataFrame([(by[0], by[1], by[2])], "a string, b string, c string")
    got = one.select(fp.combine(F.col("a"), F.col("b")).alias("u"), fp.combine(F.col("c"), F.col("b"), -1).alias("d")).first()
    assert got["u"] == by[2] and got["d"] == by[0]


def test_empty_and_single(spark):
    assert rows(spark, {}) == {}
    one = rows(spark, {3: "alone here now"})[3]
    assert one["edited_sha256"] == hashlib.sha256(b"alone here alo"[:11] + b"alo").hexdigest()


def test_ties_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a a a a"), (1, "b b b b"), (None, "c c c c"), (1, "a a a a")], "doc_id long, text string")
    got = fp.edited_fingerprints(df).collect()
    assert len(got) == 4 and len({r["fingerprint"] for r in got}) == 3


def test_lanes_against_an_independent_sum(spark):
    """Identity lanes from hashlib, likeness from signs of a hash that Spark gives for each run of three words."""

    texts = ["one two three four\nfive six", "", "one two three four", "five six\none two three four", "a b c d e f g h " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: r["fingerprint"] for r in fp.fingerprint_documents(df, ["k"]).collect()}
    assert got[0] == got[3] and len(set(got.values())) == 4
    for k, text in enumerate(texts):
        lanes, signs = [0] * fp.IDENTITY, [0] * fp.LANES
        for paragraph in text.split("\n"):
            digest = hashlib.sha256(paragraph.encode()).digest()
            lanes = [(x + int.from_bytes(digest[4 * i : 4 * i + 4], "big")) % 2**32 for i, x in enumerate(lanes)]
            w = paragraph.split(" ")
            runs = [(w[i], *((w[i + j] if i + j < len(w) else None) for j in (1, 2))) for i in range(len(w))]
            hashes = spark.createDataFrame(runs, "a string, b string, c string").select(F.xxhash64("a", "b", "c").alias("h")).select("h", F.xxhash64("h").alias("g")).collect()
            for r in hashes:
                for part, h in enumerate((r["h"] % 2**64, r["g"] % 2**64)):
                    for s in range(32):
                        signs[part * 32 + s] += 1 if h >> s & 1 else -1
                        signs[64 + part * 32 + s] += 1 if h >> (s + 32) & 1 else -1
        assert got[k][fp.LANES * 4 :] == "".join(f"{x:08x}" for x in lanes)
        assert got[k][: fp.LANES * 4] == "".join(f"{x % 2**16:04x}" for x in signs)
