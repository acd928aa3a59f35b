"""From raw documents to packed training sequences, in stages that each write their result.

Each stage works on all that the one before kept. All but the last return the columns of
``documents``. Null texts count as empty; repeated rows, null ids and empty tables are as each
operator's own description says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import shared_folder, table, write_table
from pathloom.llm.decontaminate import without_contaminated
from pathloom.llm.neardup import one_of_each_class
from pathloom.llm.packing import pack_documents
from pathloom.llm.passages import without_repeats
from pathloom.llm.toxicity import THRESHOLD, score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; labels are learned as op6 does."""
    model = train(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # so no column clashes with a score
    return score(whole, model, ["_row"]).where(F.col("score") < THRESHOLD).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates."""
    return one_of_each_class(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with lower ids have; n_chars follows the text."""
    found = without_repeats(docs)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows go by their own text, so ids may be null or repeated."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No stage but the joins between them can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        write_table(stage(spark, docs, sf_dir), f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
