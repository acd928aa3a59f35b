"""Tables that end a lineage leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

from pathloom.llm import common


def shuffles(spark):
    """Numbers of the shuffles that have files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(k).getName() for k in range(files.size())]
    return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}


def joined(spark):
    rows = spark.range(2000).withColumn("k", F.col("id") % 100)
    return rows.groupBy("k").count().join(rows.hint("merge"), "k")


def test_the_shuffles_of_a_written_table_are_removed_at_once(spark):
    plain = joined(spark)
    plain.collect()
    others = shuffles(spark)
    assert others  # they stay, as long as the driver's garbage isn't collected
    df = joined(spark)
    found = common.cut(df)
    for _ in range(100):  # executors remove them on a message
        if not (left := {s for s in shuffles(spark) if s > max(others)}):
            break
        time.sleep(0.1)
    assert not left
    assert found.count() == df.count() == 2000


def test_the_sessions_setting_is_put_back(spark):
    before = spark.conf.get(common._CLEANUP, None)
    common.cut(spark.range(3))
    assert spark.conf.get(common._CLEANUP, None) == before
    try:
        spark.conf.set(common._CLEANUP, "true")
        common.cut(spark.range(3))
        assert spark.conf.get(common._CLEANUP) == "true"
    finally:
        spark.conf.unset(common._CLEANUP)
