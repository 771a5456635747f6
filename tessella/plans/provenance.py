"""Queries of incremental execution.  ``part`` is the current state; the stored one differs from it by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import provenance as p
from tessella.plans import tables as t
from tessella.plans.query import query

_FILES = """c AS (SELECT p_name || '-' || CAST(p_partkey AS VARCHAR) AS name, p_partkey AS k, CAST(p_size AS BIGINT) AS size, CAST(p_partkey * 10 AS BIGINT) AS mtime, md5(p_type) AS md5 FROM part)"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return t.table(spark, d, "part").select(k.alias("k"), F.concat("p_name", F.lit("-"), k.cast("string")).alias("name"), F.col("p_size").cast("bigint").alias("size"), (k * 10).alias("mtime"), F.md5("p_type").alias("md5"))


@query(f"""WITH {_FILES}, s AS (SELECT name, k, size + CASE WHEN k % 10 = 1 THEN 1 ELSE 0 END AS size, mtime + CASE WHEN k % 10 IN (2, 3) THEN 5 ELSE 0 END AS mtime, CASE WHEN k % 10 = 3 THEN 'old' ELSE md5 END AS md5 FROM c WHERE k % 10 <> 4)
SELECT name, CASE WHEN s.md5 IS NULL THEN 'no signature' WHEN c.k % 10 = 5 THEN CASE WHEN c.md5 = s.md5 THEN 'valid' ELSE 'changed' END WHEN c.size IS NULL THEN 'missing' WHEN c.size <> s.size THEN 'changed' WHEN c.mtime = s.mtime THEN 'valid' WHEN c.md5 = s.md5 THEN 'valid' ELSE 'changed' END AS state
FROM (SELECT * FROM c WHERE k % 10 <> 6) c FULL JOIN s USING (name)""")
def file_validity(spark: SparkSession, d: str) -> DataFrame:
    now = _current(spark, d)
    r = F.col("k") % 10
    stored = now.where(r != 4).select("name", (F.col("size") + F.when(r == 1, 1).otherwise(0)).alias("size"), (F.col("mtime") + F.when(r.isin(2, 3), 5).otherwise(0)).alias("mtime"), F.when(r == 3, "old").otherwise(F.col("md5")).alias("md5"))
    return p.compare_files(now.where(r != 6).withColumn("zapped", r == 5).drop("k"), stored)


_STEPS = """cur AS (SELECT k // 10 AS step_id, CASE WHEN k % 2 = 0 THEN 'input' ELSE 'output' END AS role, name, md5 FROM c), sto AS (SELECT k // 10 AS step_id, CASE WHEN k % 2 = 0 THEN 'input' ELSE 'output' END AS role, name, CASE WHEN k % 170 = 3 THEN 'old' ELSE md5 END AS md5 FROM c WHERE k // 10 % 9 <> 8 AND k % 130 <> 7),
cx AS (SELECT DISTINCT k // 10 AS step_id, 'x' AS var, CAST(k // 10 % 11 AS VARCHAR) AS v FROM c WHERE k // 10 % 13 <> 5), sx AS (SELECT DISTINCT k // 10 AS step_id, 'x' AS var, CAST(CASE WHEN k // 10 % 7 = 2 THEN 99 ELSE k // 10 % 11 END AS VARCHAR) AS v FROM c)"""


@query(f"""WITH {_FILES}, {_STEPS},
t AS (SELECT step_id, count(*) FILTER (sto.name IS NOT NULL) AS known, count(*) FILTER (sto.name IS NOT NULL AND cur.name IS NULL) AS missing, count(*) FILTER (cur.name IS NOT NULL AND sto.name IS NULL) AS unsigned, count(*) FILTER (cur.md5 <> sto.md5) AS changed
 FROM (SELECT * FROM cur WHERE NOT (step_id % 17 = 4 AND role = 'input')) cur FULL JOIN sto USING (step_id, role, name) GROUP BY 1),
v AS (SELECT step_id, count(*) FILTER (cx.v IS NULL) AS lost, count(*) FILTER (cx.v <> sx.v) AS differ FROM sx LEFT JOIN cx USING (step_id, var) GROUP BY 1)
SELECT step_id, CASE WHEN known = 0 THEN 'no signature' WHEN missing > 0 THEN 'missing target' WHEN lost > 0 THEN 'missing variable' WHEN differ > 0 THEN 'variable changed' WHEN unsigned > 0 THEN 'target without signature' WHEN changed > 0 THEN 'target changed' ELSE 'match' END AS reason FROM t LEFT JOIN v USING (step_id)""")
def signature_validate(spark: SparkSession, d: str) -> DataFrame:
    """The first reason why a step cannot be skipped."""
    step = F.floor(F.col("k") / 10)
    rows = _current(spark, d).select("k", step.alias("step_id"), F.when(F.col("k") % 2 == 0, "input").otherwise("output").alias("role"), "name", "md5")
    k, s = F.col("k"), F.col("step_id")
    current = rows.where(~((s % 17 == 4) & (F.col("role") == "input")))
    stored = rows.where((s % 9 != 8) & (k % 130 != 7)).withColumn("md5", F.when(k % 170 == 3, "old").otherwise(F.col("md5")))
    steps = rows.select("step_id").distinct()
    now = steps.where(s % 13 != 5).select("step_id", F.lit("x").alias("var"), (s % 11).cast("string").alias("value_md5"))
    then = steps.select("step_id", F.lit("x").alias("var"), F.when(s % 7 == 2, 99).otherwise(s % 11).cast("string").alias("value_md5"))
    return p.validate(current, stored, now, then)


_SIGS = """i AS (SELECT l_orderkey AS step_id, string_agg(CAST(l_partkey AS VARCHAR), chr(30) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS input, string_agg(CAST(l_suppkey AS VARCHAR), chr(30) ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS output FROM lineitem GROUP BY 1),
s AS (SELECT step_id, md5('run' || chr(31) || input || chr(31) || output || chr(31) || chr(31) || 'a=' || CAST(step_id % 5 AS VARCHAR) || chr(30) || 'b=' || coalesce(o_orderstatus, '') || chr(31)) AS sig_id FROM i JOIN orders ON o_orderkey = step_id)"""


@query(f"WITH {_SIGS} SELECT step_id, sig_id FROM s")
def signature_id(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of steps that read parts and write suppliers, in the order of their lines, with two variables."""
    return _signatures(spark, d)


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).cast("string").alias("name")) for r, c in (("input", "l_partkey"), ("output", "l_suppkey"))))
    lines = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step_id"), F.lit("run").alias("body"), F.col("l_linenumber").alias("ord"), F.explode(roles).alias("t")).select("step_id", "body", "ord", "t.*")
    variables = F.array(F.struct(F.lit("b").alias("var"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("a").alias("var"), (F.col("o_orderkey") % 5).cast("string").alias("value")))
    return p.signature_ids(lines, t.table(spark, d, "orders").select(F.col("o_orderkey").alias("step_id"), F.explode(variables).alias("v")).select("step_id", "v.*"))


@query("SELECT l_orderkey AS step_id, CAST(l_linenumber AS BIGINT) AS gid FROM lineitem WHERE l_linenumber > 3")
def loop_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Loops over lines that once had three at most: only the groups that are new run."""
    groups = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step_id"), F.col("l_linenumber").cast("bigint").alias("gid"), p.signature_id(F.lit("run"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")).alias("sig_id"))
    return p.groups_to_run(groups, groups.where("gid <= 3")).select("step_id", "gid")


@query(f"WITH {_FILES}, r AS (SELECT k, CASE WHEN k % 6 = 0 THEN 'no signature' WHEN k % 6 = 1 THEN 'target changed' ELSE 'match' END AS reason FROM c), m AS (SELECT unnest(['default', 'skip', 'force', 'ignore', 'build']) AS mode) SELECT mode, k AS step_id FROM r, m WHERE mode IN ('force', 'ignore') OR (mode IN ('default', 'skip') AND reason <> 'match')")
def modes_to_run(spark: SparkSession, d: str) -> DataFrame:
    """What runs in each signature mode."""
    k = F.col("k")
    decisions = _current(spark, d).select(k.alias("step_id"), F.when(k % 6 == 0, "no signature").when(k % 6 == 1, "target changed").otherwise("match").alias("reason"))
    parts = [p.to_run(decisions, mode).select(F.lit(mode).alias("mode"), "step_id") for mode in ("default", "skip", "force", "ignore", "build")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""SELECT k, coalesce(a IS NOT NULL AND (b IS NULL OR a > b), FALSE) AS fresh FROM (SELECT l_orderkey AS k, min(l_shipdate) AS a FROM lineitem GROUP BY 1) FULL JOIN (SELECT o_orderkey AS k, max(o_orderdate) AS b FROM orders GROUP BY 1) USING (k)""")
def later_than(spark: SparkSession, d: str) -> DataFrame:
    """Whether all lines of an order are newer than the order."""
    left = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("mtime"))
    return p.later_than(left, t.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("mtime")), "k")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND n_chars >= 1000")
def tracked_files(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").where(p.size_filter(F.col("n_chars"), 1000))
    return p.tracked(docs, t.table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars <= 1000")
def untracked_files(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").where(p.size_filter(F.col("n_chars"), -1000))
    return p.untracked(docs, t.table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars")


@query("SELECT o_orderkey FROM orders WHERE date_diff('second', o_orderdate, TIMESTAMP '2002-01-01') >= 900 * 86400")
def age_filter(spark: SparkSession, d: str) -> DataFrame:
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return t.table(spark, d, "orders").where(p.age_filter(seconds(F.col("o_orderdate")), seconds(F.lit("2002-01-01")), "+900d")).select("o_orderkey")


@query("SELECT DISTINCT a.l_orderkey AS gid, CAST(a.l_partkey AS VARCHAR) AS name FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_suppkey")
def overlap_guard(spark: SparkSession, d: str) -> DataFrame:
    lines = t.table(spark, d, "lineitem")
    name = lambda c: lines.select(F.col("l_orderkey").alias("gid"), F.col(c).cast("string").alias("name"))
    return p.overlapping(name("l_partkey"), name("l_suppkey"))


@query("SELECT CAST(l_partkey AS VARCHAR) AS name, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def shared_outputs(spark: SparkSession, d: str) -> DataFrame:
    return p.shared_outputs(t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_partkey").cast("string").alias("name")))


@query("SELECT l_orderkey AS gid, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS n_missing FROM lineitem GROUP BY 1")
def missing_inputs(spark: SparkSession, d: str) -> DataFrame:
    members = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_partkey").cast("string").alias("name"))
    return p.missing_inputs(members, t.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("name")))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_signature(spark: SparkSession, d: str) -> DataFrame:
    """The newest record of each key of an append-only store."""
    return p.latest(t.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
