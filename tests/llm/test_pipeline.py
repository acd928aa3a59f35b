"""The pipeline's stages on a small corpus with one planted case of each kind."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from pathloom.llm import queries
from pathloom.llm.common import table


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    make = lambda n: [word() for _ in range(n)]
    text = lambda w: " ".join(w).capitalize() + "."
    item, passage = make(30), make(60)
    docs, labels = {}, []
    for i in range(300):
        w = make(rng.randint(60, 90))
        if i % 5 == 0:
            w[7] = "grumblor"
        docs[i] = text(w)
        labels.append((i, 1, int(i % 5 == 0)))
    base = make(120)
    docs[1001], docs[1002] = text(base), text([*base[:60], "other", *base[61:]])
    docs[1003] = docs[1001]
    docs[1004], docs[1005] = text(make(70) + passage), text(make(70) + passage + make(10))
    docs[1006] = text(make(20)) + " " + text(item) + " " + text(make(20))
    docs[1007], docs[1008] = "", None
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, t, "en", "s", len(t or ""), float(k)) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, text(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, passage


def test_stages(spark, corpus):
    folder, docs, passage = corpus
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = df.columns, set(docs)
    for name, stage in cp.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, folder).collect(), df.schema)
        assert df.columns == columns
        now = {r["doc_id"]: r["text"] for r in df.collect()}
        gone = ids - set(now)
        if name == "toxicity":
            assert gone == {i for i in range(0, 300, 5)}
        if name == "near_duplicates":
            assert gone == {1002, 1003, 1008}
        if name == "repeated_passages":
            assert not gone and now[1004] == docs[1004]
            assert " ".join(passage[:10]) not in now[1005].lower() and len(now[1005].split()) == 80
            assert all(now[k] == docs[k] for k in now if k != 1005)
        if name == "decontamination":
            assert gone == {1006}
        ids = set(now)


def test_run(spark, corpus):
    folder, docs, _ = corpus
    rows = cp.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(docs) - set(range(0, 300, 5)) - {1002, 1003, 1008, 1006}
    assert all(r["length"] <= 4096 for r in rows) and len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert "pipeline" in queries.QUERIES


def test_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_batches_of_long_texts_are_bounded_by_bytes(spark, tmp_path):
    spark.range(64).selectExpr("id as doc_id", "repeat('x', 1000000) as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    own = spark.newSession()  # the session's settings are left as they were
    found = [r["n"] for r in table(own, str(tmp_path), "documents").mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 64_000_000 and max(found) < 10_000_000
