"""EXT: Spark features beyond the core, under names that say so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import tables as t
from tessella.plans.query import query


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(_cents("value")).alias("cents")).select(F.col("w.start").alias("hour"), "event_type", "n", "cents")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 14400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(_cents("l_extendedprice")).alias("cents"))


@query("SELECT r_name, o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def ext_join(spark: SparkSession, d: str) -> DataFrame:
    f = lambda n: t.table(spark, d, n)
    joined = f("orders").join(f("customer"), F.col("o_custkey") == F.col("c_custkey")).join(f("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(f("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(_cents("o_totalprice")).alias("cents"))
