"""Language identification: held-out accuracy, rejection and edge cases."""

import pyarrow as pa
import pyarrow.parquet as pq

from pathloom.llm import language

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in pq.read_table(DATA, columns=["doc_id", "lang"]).to_pylist()}
    rows = language.identify(spark.read.parquet(DATA)).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_rows(spark):
    some = [(i, f"the house and the tree number {i}", "en", 1) for i in range(20)] + [(30 + i, f"der Hund und die Katze {i}", "de", 1) for i in range(20)]
    some += [(60, None, "en", 1), (61, "", None, 1), (62, "12 34 !?", "de", 1), (None, "the tree and the house", "en", 1), (60, "und der Hund", None, 1)]
    got = language.identify(spark.createDataFrame(some, "doc_id long, text string, lang string, score int")).collect()
    assert len(got) == len(some)
    by = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert by.count((60, "und")) == 1 and by.count((60, "de")) == 1
    assert (61, "und") in by and (62, "und") in by and (None, "en") in by
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(unlabelled).first()["lang_pred"] == "und"


def test_counts_cover_whole_texts():
    short, some = language.counts(pa.array(["ab", "ab " * 50_000, None, "…"]))
    assert some.tolist() == [True, True, False, False] and short[1].sum() > 100_000


def test_rejection_of_foreign_text(spark):
    rows = [("the house and the tree of the town number " + str(i), "en") for i in range(200)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    far = language.predict(spark.createDataFrame([("zzxxqq vvkkjj yyww", 1), ("the tree of the house", 2)], "text string, k int"), model, ["k"])
    assert {r["k"]: r["rejected"] for r in far.collect()} == {1: True, 2: False}


def test_copies_do_not_crowd_the_sample(spark):
    from pyspark.sql import functions as F

    texts = spark.range(3000).select(F.concat(F.lit("text "), "id").alias("text"), F.lit("xx").alias("lang"))
    rows = texts.union(spark.range(3000).select(F.lit("one hot text"), F.lit("xx"))).union(spark.range(5).select(F.lit("y" * 200_000), F.lit("yy")))
    drawn, totals = language.sample(rows, "lang", 600)
    assert len(drawn) == len({r["text"] for r in drawn}) == 600 and totals == {"xx": 6000, "yy": 5}
