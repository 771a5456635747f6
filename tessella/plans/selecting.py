"""Queries that select from collections, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.ranges import in_ranges
from tessella.operators.targets import TargetSet
from tessella.plans import tables as t
from tessella.plans.query import query


@query(f"WITH {t.ORDERS} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, name FROM o WHERE label = '1-URGENT'")
def select_label(spark: SparkSession, d: str) -> DataFrame:
    return t.orders(spark, d).select("1-URGENT").targets.select("idx", "name")


@query(f"""WITH {t.CUSTOMERS}, k AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new FROM c WHERE label = 'BUILDING'), g AS (SELECT DISTINCT idx // 4 AS gid FROM c),
m AS (SELECT idx // 4 AS gid, row_number() OVER (PARTITION BY idx // 4 ORDER BY idx) - 1 AS pos, new FROM k) SELECT g.gid, count(new) AS n, coalesce(min(new), -1) AS first_idx FROM g LEFT JOIN m USING (gid) GROUP BY 1""")
def select_label_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups shrink under a label, and stay when they become empty."""
    ts = t.customers(spark, d).group_by(4).select("BUILDING")
    return ts.groups.join(ts.members.groupBy("gid").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")), "gid", "left").na.fill({"n": 0, "first_idx": -1})


@query(f"""WITH {t.CUSTOMERS}, m AS (SELECT idx // 4 AS gid, row_number() OVER (PARTITION BY idx // 4 ORDER BY idx) - 1 AS pos, row_number() OVER (ORDER BY idx) - 1 AS idx FROM c WHERE label = 'BUILDING'), g AS (SELECT gid, row_number() OVER (ORDER BY gid) - 1 AS new FROM (SELECT DISTINCT gid FROM m))
SELECT new AS gid, pos, idx FROM m JOIN g USING (gid)""")
def drop_empty(spark: SparkSession, d: str) -> DataFrame:
    return t.customers(spark, d).group_by(4).select("BUILDING").remove_empty_groups().members.select("gid", "pos", "idx")


@query(f"WITH {t.PARTS} SELECT a.o AS idx, p.name FROM (VALUES (0, 5), (1, 3), (2, 11), (3, 0)) AS a(o, i) JOIN p ON p.idx = a.i".replace("a.o AS", "CAST(a.o AS BIGINT) AS"))
def select_positions(spark: SparkSession, d: str) -> DataFrame:
    return t.parts(spark, d).select([5, 3, 11, 0]).targets.select("idx", "name")


@query(f"WITH {t.PARTS} SELECT idx - 10 AS idx, name FROM p WHERE idx BETWEEN 10 AND cnt - 6")
def select_slice(spark: SparkSession, d: str) -> DataFrame:
    return t.parts(spark, d).select(slice(10, -5)).targets.select("idx", "name")


@query(f"WITH {t.PARTS} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, name FROM p WHERE p_size >= 25")
def select_where(spark: SparkSession, d: str) -> DataFrame:
    return t.parts(spark, d).select(F.col("p_size") >= 25).targets.select("idx", "name")


@query(f"WITH {t.PARTS} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, name FROM p WHERE p_size % 4 <> 0")
def remove_kind(spark: SparkSession, d: str) -> DataFrame:
    ts = t.parts(spark, d)
    mixed = TargetSet(ts.targets.withColumn("kind", F.when(F.col("p_size") % 4 == 0, "invalid").otherwise(F.col("kind"))))
    return mixed.remove_kind("invalid").targets.select("idx", "name")


@query(f"WITH {t.PARTS}, g AS (SELECT DISTINCT idx // 7 AS gid FROM p) SELECT gid FROM g WHERE gid >= 1 AND gid % 2 = 1")
def active_slice(spark: SparkSession, d: str) -> DataFrame:
    return t.parts(spark, d).group_by(7).active(slice(1, None, 2))


@query(f"WITH {t.PARTS}, g AS (SELECT DISTINCT idx // 7 AS gid FROM p) SELECT gid FROM g WHERE gid = (SELECT max(gid) - 1 FROM g)")
def active_negative(spark: SparkSession, d: str) -> DataFrame:
    return t.parts(spark, d).group_by(7).active(-2)


@query(f"WITH {t.PARTS}, m AS (SELECT idx // 7 AS gid, p_size FROM p) SELECT gid, CASE WHEN max(p_size) >= 48 THEN CAST(0 AS BIGINT) ELSE count(*) END AS n FROM m GROUP BY 1")
def skip_groups(spark: SparkSession, d: str) -> DataFrame:
    """A substep whose largest size is 48 or more is skipped: its group stays, without members."""
    ts = t.parts(spark, d).group_by(7)
    skipped = ts.members.join(ts.targets, "idx").groupBy("gid").agg(F.max("p_size").alias("m")).where("m >= 48").select("gid")
    left = ts.skip(skipped)
    return left.groups.join(left.members.groupBy("gid").agg(F.count("*").alias("n")), "gid", "left").na.fill(0, ["n"])


@query("WITH t AS (SELECT min(doc_id) AS first_id, md5(text) AS name FROM documents GROUP BY text) SELECT row_number() OVER (ORDER BY first_id) - 1 AS idx, name FROM t")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """Each different text once, where it first comes."""
    return TargetSet.from_table(t.table(spark, d, "documents"), F.md5("text"), "doc_id").first_of_name().targets.select("idx", "name")


@query(f"WITH {t.BOTH} SELECT idx, name, label FROM b")
def concatenate(spark: SparkSession, d: str) -> DataFrame:
    return t.regions(spark, d).merge(t.nations(spark, d)).targets.select("idx", "name", "label")


@query(f"WITH {t.CUSTOMERS}, k AS (SELECT idx, name FROM c WHERE name NOT IN (SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000)) SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, name FROM k")
def difference(spark: SparkSession, d: str) -> DataFrame:
    """Customers less those with an order of more than 450000."""
    ordered = t.table(spark, d, "customer").join(t.table(spark, d, "orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return t.customers(spark, d).without(TargetSet.from_table(ordered, "c_name", "c_custkey")).targets.select("idx", "name")


@query("SELECT DISTINCT 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS name FROM lineitem WHERE 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') IN (SELECT s_name FROM supplier)")
def contains(spark: SparkSession, d: str) -> DataFrame:
    asked = t.table(spark, d, "lineitem").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("name")).distinct()
    return t.suppliers(spark, d).contains(asked)


@query(f"WITH {t.ORDERS} SELECT row_number() OVER (ORDER BY min(idx)) - 1 AS ord, label FROM o GROUP BY label")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Labels in the order of their first appearance."""
    ts = t.orders(spark, d).group_by("label")
    return ts.listed().where("pos = 0").select(F.col("gid").alias("ord"), "label")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 2 AND 400 OR o_orderkey >= 1000")
def step_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Steps in ``2-400,1000-``."""
    return t.table(spark, d, "orders").where(in_ranges(F.col("o_orderkey"), "2-400,1000-")).select("o_orderkey")
