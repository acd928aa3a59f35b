"""Streams give what the batch operators give on the same rows."""

from pathloom.streaming import transitions


def test_pairs_over_two_batches(spark, tmp_path):
    schema = "sid string, ord int, state string"
    one = spark.createDataFrame([("a", 1, "X"), ("a", 2, "Y"), ("b", 1, "X")], schema)
    two = spark.createDataFrame([("a", 3, "X"), ("b", 2, "Z"), ("a", 1, "late"), (None, 1, "X")], schema)
    one.write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = transitions.stream_transitions(stream, "sid", "ord", "state")
    q = out.writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    try:
        q.processAllAvailable()
        two.write.parquet(f"{tmp_path}/in/2")
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("select * from pairs").collect())
    finally:
        q.stop()
    assert got == [("a", "X", "Y"), ("a", "Y", "X"), ("b", "X", "Z")]
