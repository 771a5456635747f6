"""Queries of steps: orders are outputs, their customer a numbered step of one of five workflows, the priority a label."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import steps
from tessella.plans import tables as t
from tessella.plans.query import query

_OUT = "o AS (SELECT 'w' || CAST(o_custkey % 5 AS VARCHAR) || '_' || CAST(o_custkey AS VARCHAR) AS step, o_custkey AS n, 'w' || CAST(o_custkey % 5 AS VARCHAR) AS wf, o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS label FROM orders)"


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    wf = F.concat(F.lit("w"), (F.col("o_custkey") % 5).cast("string"))
    return t.table(spark, d, "orders").select(F.concat(wf, F.lit("_"), F.col("o_custkey").cast("string")).alias("step"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("label"))


@query(f"WITH {_OUT}, l AS (SELECT wf, max(n) AS n FROM o WHERE wf IN ('w1', 'w3') GROUP BY 1) SELECT row_number() OVER (ORDER BY wf DESC, ord) - 1 AS idx, name, step AS label FROM o JOIN l USING (wf, n)")
def output_from(spark: SparkSession, d: str) -> DataFrame:
    """The last steps of two workflows, one after the other."""
    return steps.output_from(_outputs(spark, d), ["w3", "w1"]).targets.select("idx", "name", "label")


_LAST_TWO = "z AS (SELECT max(n) AS cur FROM o WHERE wf = 'w1'), pv AS (SELECT max(n) AS prev FROM o, z WHERE wf = 'w1' AND n < cur), f AS (SELECT min(n) AS low FROM o WHERE wf = 'w1'), q AS (SELECT row_number() OVER (ORDER BY CASE WHEN n = prev THEN 0 ELSE 1 END, ord) - 1 AS idx, name, step FROM o, pv, f WHERE wf = 'w1' AND (n = prev OR n = low))"


@query(f"WITH {_OUT}, {_LAST_TWO}, v AS (SELECT * FROM (VALUES (0, 'a'), (1, 'b')) AS x(o_, tag)) SELECT o_ * ceil((SELECT count(*) FROM q) / 3.0)::BIGINT + idx // 3 AS gid, idx % 3 AS pos, name, step AS label, substr(name, 1, 1) AS head, tag, 'p' AS batch FROM q, v")
def output_from_options(spark: SparkSession, d: str) -> DataFrame:
    """The step before the current one and a step by its number, with all options of a collection."""
    out = _outputs(spark, d)
    own = out.where(F.col("step").startswith("w1_")).agg(F.max(steps.step_number(F.col("step"))).alias("n"), F.min(steps.step_number(F.col("step"))).alias("low")).first()
    ts = steps.output_from(out, [-1, own.low], current=f"w1_{own.n}", pattern="{head,.}{rest,.*}", paired_with={"batch": "p"}, group_by=3, for_each={"tag": ["a", "b"]}, remove_empty_groups=True)
    return ts.listed().join(ts.groups, "gid").join(ts.targets.select("idx", "head", "batch"), "idx").select("gid", "pos", "name", "label", "head", "tag", "batch")


@query(f"WITH {_OUT}, k AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY ord) - 1 AS r, count(*) OVER (PARTITION BY step) AS m FROM o) SELECT step, CAST(sum(ord) AS BIGINT) AS total, count(*) AS n FROM k WHERE ord % 4 <> 0 GROUP BY 1")
def required_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs behind a check that ends the query if it fails, and a condition that is only counted."""
    out = _outputs(spark, d).where("ord % 4 <> 0")
    checked = steps.fail_if(out, F.col("ord") < 0, "no order has such a key")
    watched = steps.warn_if(checked, F.col("label") == "2-HIGH", "urgent")
    return watched.groupBy("step").agg(F.sum("ord").alias("total"), F.count("*").alias("n"))


@query(f"WITH {_OUT}, f AS (SELECT arg_min(step, n) AS step FROM o WHERE label = '2-HIGH') SELECT row_number() OVER (ORDER BY ord) - 1 AS idx, name FROM o WHERE label = '2-HIGH' AND step = (SELECT step FROM f)")
def named_output(spark: SparkSession, d: str) -> DataFrame:
    return steps.named_output(_outputs(spark, d), "2-HIGH").targets.select("idx", "name")


@query(f"WITH {_OUT}, s AS (SELECT DISTINCT step, n, wf FROM o) SELECT * FROM (SELECT step, lag(step) OVER (PARTITION BY wf ORDER BY n) AS previous FROM s) WHERE previous IS NOT NULL")
def previous_step(spark: SparkSession, d: str) -> DataFrame:
    return steps.previous_step(_outputs(spark, d).select("step").distinct())


@query(f"WITH {_OUT} SELECT (SELECT arg_max(step, n) FROM o WHERE wf = 'w1') AS src, (SELECT arg_min(step, n) FROM o WHERE wf = 'w2') AS dst")
def combined_workflows(spark: SparkSession, d: str) -> DataFrame:
    out = _outputs(spark, d)
    return steps.combine(out.where(F.col("step").startswith("w1_")), out.where(F.col("step").startswith("w2_")))


@query(f"WITH {t.PARTS} SELECT idx // 100 AS gid, string_agg(CAST(p_size AS VARCHAR), '' ORDER BY idx) AS sizes FROM p GROUP BY 1")
def body_per_group(spark: SparkSession, d: str) -> DataFrame:
    """A Python body over the ordered members of each group."""
    body = lambda gid, part: pd.DataFrame({"gid": [gid], "sizes": ["".join(map(str, part["p_size"]))]})
    return steps.run_body(t.parts(spark, d).group_by(100), body, "gid long, sizes string")


@query("SELECT c_custkey AS node_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0) THEN 'completed' ELSE 'pending' END AS status FROM customer")
def regenerated_steps(spark: SparkSession, d: str) -> DataFrame:
    """Customers are steps that make orders; every tenth order is lost."""
    nodes = t.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 2 == 0, "completed").otherwise("pending").alias("status"))
    orders = t.table(spark, d, "orders")
    io = orders.select(F.col("o_custkey").alias("node_id"), F.lit("output").alias("role"), F.col("o_orderkey").alias("target"))
    return steps.regenerate(nodes, io, orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("target")))


@query("SELECT page_id, CASE WHEN url LIKE '%.csv' THEN 'csv' WHEN url LIKE '%.html' THEN 'html' ELSE 'text' END AS shown_by FROM pages")
def previewer(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").select("page_id", steps.previewer(F.col("url")).alias("shown_by"))


@query("SELECT page_id, CASE WHEN url LIKE '%.csv' THEN 'csv' WHEN url LIKE '%.html' THEN 'html' WHEN regexp_matches(html, '^\\s*(<!doctype html|<html)', 'i') THEN 'html' ELSE 'text' END AS shown_by FROM pages")
def previewer_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose address says nothing are known by how they start."""
    return t.table(spark, d, "pages").select("page_id", steps.previewer(F.col("url"), content=F.col("html")).alias("shown_by"))
