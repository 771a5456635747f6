"""How the driver's tables stand for collections of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.targets import TargetSet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> TargetSet:
    return TargetSet.from_table(table(spark, sf_dir, "part"), "p_name", "p_partkey", attributes=["p_size"])


def orders(spark: SparkSession, sf_dir: str) -> TargetSet:
    return TargetSet.from_table(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "o_orderpriority")


def customers(spark: SparkSession, sf_dir: str) -> TargetSet:
    return TargetSet.from_table(table(spark, sf_dir, "customer"), "c_name", "c_custkey", "c_mktsegment", attributes=["c_acctbal"])


def suppliers(spark: SparkSession, sf_dir: str) -> TargetSet:
    return TargetSet.from_table(table(spark, sf_dir, "supplier"), "s_name", "s_suppkey")


def nations(spark: SparkSession, sf_dir: str) -> TargetSet:
    return TargetSet.from_table(table(spark, sf_dir, "nation"), "n_name", "n_nationkey", F.lit("nation"))


def regions(spark: SparkSession, sf_dir: str) -> TargetSet:
    return TargetSet.from_table(table(spark, sf_dir, "region"), "r_name", "r_regionkey", F.lit("region"))


#: The same collections in SQL.
PARTS = "p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, p_name AS name, p_size, count(*) OVER () AS cnt FROM part)"
ORDERS = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS label FROM orders)"
CUSTOMERS = "c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_name AS name, c_mktsegment AS label, c_acctbal FROM customer)"
SUPPLIERS = "s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_name AS name FROM supplier)"
NATIONS = "n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name AS name, 'nation' AS label FROM nation)"
REGIONS = "r AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS idx, r_name AS name, 'region' AS label FROM region)"
BOTH = f"{REGIONS}, {NATIONS}, b AS (SELECT idx, name, label FROM r UNION ALL SELECT idx + (SELECT count(*) FROM r), name, label FROM n)"
