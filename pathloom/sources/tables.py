"""The tables of a folder, and the sequences that queries read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVT = {"sequence_id_col": "user_id", "order_col": "ord", "state_col": "event_type"}
CONV = {"sequence_id_col": "conv_id", "order_col": "turn", "state_col": "role"}
LIN = {"sequence_id_col": "l_orderkey", "order_col": "l_linenumber", "state_col": "l_returnflag"}
PAN = {"sequence_id_col": "sid", "order_col": "ord", "state_col": "o_orderpriority"}

#: Line items that a task sorts, about.
TASK_ROWS = 250_000

#: The same sequences in SQL.
EVT_SQL = (
    "evt AS (SELECT CAST(user_id AS VARCHAR) AS sequence_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_type AS state, "
    "value AS duration, event_id, 'g' || CAST(user_id % 2 AS VARCHAR) AS grp FROM events)"
)
CONV_SQL = "conv AS (SELECT CAST(conv_id AS VARCHAR) AS sequence_id, CAST(turn AS BIGINT) AS ord, role AS state, 'g' || CAST(conv_id % 2 AS VARCHAR) AS grp FROM conversations)"
LIN_SQL = (
    "lin AS (SELECT CAST(l_orderkey AS VARCHAR) AS sequence_id, l_linenumber AS ord, l_returnflag AS state, l_quantity AS duration, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)"
)
PAN_SQL = (
    "pan AS (SELECT CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS sequence_id, CAST(o_custkey AS VARCHAR) AS panel_id, year(o_orderdate) AS occasion, "
    "row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS ord, o_orderpriority AS state FROM orders)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    group = F.concat(F.lit("g"), (F.col("user_id") % 2).cast("string"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", group.alias("grp"))
    return rows.select("user_id", F.row_number().over(order).cast("long").alias("ord"), "event_type", "value", "event_id", "grp")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("g"), (F.col("conv_id") % 2).cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", group.alias("grp"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``rn``, a position within the order that all columns decide."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.repartition(max(8, -(-rows.count() // TASK_ROWS)), "l_orderkey")  # a task's sorts don't grow with the table
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", F.row_number().over(order).cast("long").alias("rn"))


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one sequence per customer and year."""
    year = F.year("o_orderdate")
    order = Window.partitionBy("o_custkey", year).orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat_ws("-", F.col("o_custkey").cast("string"), year.cast("string")).alias("sid"), F.col("o_custkey").cast("string").alias("panel_id"), year.alias("occasion"),
        F.row_number().over(order).cast("long").alias("ord"), "o_orderpriority",
    )
