"""Queries of the grouping modes and of folds over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ordinal import with_ordinal, with_rank_in
from tessella.operators import steps
from tessella.operators.targets import TargetSet
from tessella.plans import tables as t
from tessella.plans.query import query


def _members(ts: TargetSet) -> DataFrame:
    return ts.members.select("gid", "pos", "idx")


def _fold(ts: TargetSet) -> DataFrame:
    """Per group, the empty ones too: members, first and last name, sum of p_size."""
    joined = ts.members.join(ts.targets, "idx").groupBy("gid").agg(F.count("*").alias("n"), F.min_by("name", "pos").alias("first_name"), F.max_by("name", "pos").alias("last_name"), F.sum("p_size").alias("sum_size"))
    return ts.groups.select("gid").join(joined, "gid", "left").na.fill(0, ["n", "sum_size"])


@query(f"WITH {t.PARTS} SELECT idx AS gid, CAST(0 AS BIGINT) AS pos, idx FROM p")
def group_single(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.parts(spark, d).group_by("single"))


@query(f"WITH {t.PARTS} SELECT CAST(0 AS BIGINT) AS gid, count(*) AS n, arg_min(name, idx) AS first_name, arg_max(name, idx) AS last_name, CAST(sum(p_size) AS BIGINT) AS sum_size FROM p")
def group_all(spark: SparkSession, d: str) -> DataFrame:
    return _fold(t.parts(spark, d).group_by("all"))


@query(f"WITH {t.PARTS} SELECT idx // 7 AS gid, count(*) AS n, arg_min(name, idx) AS first_name, arg_max(name, idx) AS last_name, CAST(sum(p_size) AS BIGINT) AS sum_size FROM p GROUP BY 1")
def group_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _fold(t.parts(spark, d).group_by(7))


_LABELLED = f"WITH {t.ORDERS}, f AS (SELECT label, min(idx) AS first FROM o GROUP BY 1), g AS (SELECT label, row_number() OVER (ORDER BY first) - 1 AS gid FROM f)"


@query(f"{_LABELLED} SELECT gid, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS pos, idx FROM o JOIN g USING (label)")
def group_label(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.orders(spark, d).group_by("label"))


@query(f"{_LABELLED} SELECT gid, any_value(label) AS label, count(*) AS n, min(idx) AS first_idx FROM o JOIN g USING (label) GROUP BY 1")
def group_label_fold(spark: SparkSession, d: str) -> DataFrame:
    return t.orders(spark, d).group_by("source").listed().groupBy("gid").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.min("idx").alias("first_idx"))


@query(f"WITH {t.PARTS} SELECT idx % (cnt // 2) AS gid, idx // (cnt // 2) AS pos, idx FROM p")
def group_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.parts(spark, d).group_by("pairs"))


@query(f"WITH {t.PARTS} SELECT (idx % (cnt // 2)) // 5 AS gid, (idx // (cnt // 2)) * 5 + (idx % (cnt // 2)) % 5 AS pos, idx FROM p")
def group_pairs_n(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.parts(spark, d).group_by("pairs5"))


@query(f"WITH {t.PARTS}, h AS (SELECT idx - k AS gid, CAST(k AS BIGINT) AS pos, idx, cnt FROM p, (VALUES (0), (1)) AS v(k)) SELECT gid, pos, idx FROM h WHERE gid >= 0 AND gid < cnt - 1")
def group_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.parts(spark, d).group_by("pairwise"))


@query(f"WITH {t.PARTS}, h AS (SELECT idx // 4 - k AS gid, k * 4 + idx % 4 AS pos, idx, cnt FROM p, (VALUES (0), (1)) AS v(k)) SELECT gid, pos, idx FROM h WHERE gid >= 0 AND gid < cnt // 4 - 1")
def group_pairwise_n(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.parts(spark, d).group_by("pairwise4"))


@query(f"WITH {t.SUPPLIERS}, g AS (SELECT row_number() OVER (ORDER BY a.idx, b.idx) - 1 AS gid, a.idx AS i0, b.idx AS i1 FROM s a JOIN s b ON a.idx < b.idx) SELECT gid, CAST(0 AS BIGINT) AS pos, i0 AS idx FROM g UNION ALL SELECT gid, CAST(1 AS BIGINT), i1 FROM g")
def group_combinations2(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.suppliers(spark, d).group_by("combinations"))


@query(f"""WITH {t.NATIONS}, g AS (SELECT row_number() OVER (ORDER BY a.idx, b.idx, c.idx) - 1 AS gid, [a.idx, b.idx, c.idx] AS l FROM n a JOIN n b ON a.idx < b.idx JOIN n c ON b.idx < c.idx)
SELECT gid, CAST(p AS BIGINT) AS pos, l[p + 1] AS idx FROM g, (VALUES (0), (1), (2)) AS v(p)""")
def group_combinations3(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.nations(spark, d).group_by("combinations3"))


def _both(spark: SparkSession, d: str) -> TargetSet:
    named = lambda table, key, label: TargetSet.from_table(t.table(spark, d, table), f"{key[0]}_name", key, F.lit(label))
    return named("supplier", "s_suppkey", "supplier").merge(named("customer", "c_custkey", "customer"))


_BOTH = f"{t.SUPPLIERS}, {t.CUSTOMERS}, b AS (SELECT idx, 'supplier' AS label FROM s UNION ALL SELECT idx + (SELECT count(*) FROM s), 'customer' FROM c), k AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY label) AS m FROM b)"


@query(f"""WITH {_BOTH}, g AS (SELECT unnest(range((SELECT max(m) FROM k))) AS gid)
SELECT gid, CASE label WHEN 'supplier' THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS pos, idx FROM k JOIN g ON gid // ((SELECT max(m) FROM k) // m) = r""")
def group_pairlabel(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier stands beside fifteen customers, one a group."""
    return _members(_both(spark, d).group_by("pairlabel"))


@query(f"""WITH {_BOTH}, g AS (SELECT unnest(range((SELECT max(m) // 5 FROM k))) AS gid)
SELECT gid, CAST(0 AS BIGINT) AS pos, idx FROM k JOIN g ON label = 'supplier' AND gid // ((SELECT max(m) // 5 FROM k) // m) = r UNION ALL SELECT r // 5, 1 + r % 5, idx FROM k WHERE label = 'customer'""")
def group_pairlabel_n(spark: SparkSession, d: str) -> DataFrame:
    return _members(_both(spark, d).group_by("pairsource5"))


@query(f"WITH {t.CUSTOMERS} SELECT idx % 3 AS gid, row_number() OVER (PARTITION BY idx % 3 ORDER BY idx) - 1 AS pos, idx FROM c WHERE idx % 5 <> 4")
def group_function(spark: SparkSession, d: str) -> DataFrame:
    return _members(t.customers(spark, d).group_by(lambda idx: F.when(idx % 5 != 4, idx % 3)))


@query(f"WITH {t.CUSTOMERS}, m AS (SELECT idx // 4 AS gid, idx FROM c UNION ALL SELECT idx // 4 - 1, idx FROM c WHERE idx % 4 = 0 AND idx >= 4) SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY idx) - 1 AS pos, idx FROM m")
def group_function_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """A function that gives several groups: fours that also hold the first of the next."""
    own = lambda idx: F.floor(idx / 4)
    return _members(t.customers(spark, d).group_by(lambda idx: F.when((idx % 4 == 0) & (idx >= 4), F.array(own(idx), own(idx) - 1)).otherwise(F.array(own(idx)))))


@query(f"WITH {t.ORDERS}, l AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders), g AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS gid FROM (SELECT DISTINCT k FROM l)) SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY idx DESC) - 1 AS pos, idx FROM l JOIN g USING (k)")
def group_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of positions: the orders of each customer, last first.  Orders and customers are many: neither is broadcast."""
    ts = t.orders(spark, d)
    rows = ts.targets.select("idx", F.col("name").cast("bigint").alias("o_orderkey")).join(t.table(spark, d, "orders").select("o_orderkey", "o_custkey").hint("merge"), "o_orderkey")
    gids = with_ordinal(rows.select("o_custkey").distinct(), "o_custkey", name="gid")
    ranked = with_rank_in(rows.select("o_custkey", "idx", (-F.col("idx")).alias("_back")), "o_custkey", "_back", name="pos")
    return _members(ts.group_by(ranked.join(gids.hint("merge"), "o_custkey").select("gid", "pos", "idx")))


@query(f"WITH {t.PARTS}, o AS (SELECT idx // 7 AS gid, idx % 7 AS pos, 'size-' || CAST(p_size AS VARCHAR) AS name, idx FROM p), f AS (SELECT name, min(idx) AS idx FROM o GROUP BY 1) SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY pos) - 1 AS pos, row_number() OVER (ORDER BY idx) - 1 AS idx, name FROM o JOIN f USING (name, idx)")
def collect_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Each group of seven yields outputs by size; together they are one collection, a group each, in which a name counts once."""
    ts = t.parts(spark, d).group_by(7)
    made = ts.members.join(ts.targets, "idx").select("gid", F.col("pos").alias("ord"), F.concat(F.lit("size-"), F.col("p_size").cast("string")).alias("name"))
    return steps.collect_outputs(made, ts.groups.count()).listed().select("gid", "pos", "idx", "name")


@query(f"WITH {t.CUSTOMERS}, g AS (SELECT idx // 10 AS gid, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS x FROM c GROUP BY 1) SELECT count(*) AS n_substeps, CAST(sum(x) AS BIGINT) AS total_x, arg_max(x, gid) AS last_x FROM g")
def shared_values(spark: SparkSession, d: str) -> DataFrame:
    """A value of each substep, summed over all, and that of the last substep."""
    return steps.shared_totals(_cents(spark, d), ["x"])


@query(f"WITH {t.CUSTOMERS}, g AS (SELECT idx // 10 AS gid, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS x FROM c GROUP BY 1) SELECT arg_max(x, gid) AS balance, string_agg(CAST(x AS VARCHAR), ',' ORDER BY gid) AS step_balance FROM g")
def shared_lists(spark: SparkSession, d: str) -> DataFrame:
    """The values of all substeps in their order, under a name of its own."""
    return steps.shared_values(_cents(spark, d), {"x": "balance"}).select("balance", F.array_join(F.col("step_balance").cast("array<string>"), ",").alias("step_balance"))


def _cents(spark: SparkSession, d: str) -> DataFrame:
    ts = t.customers(spark, d).group_by(10)
    return ts.members.join(ts.targets.select("idx", "c_acctbal"), "idx").groupBy("gid").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("x"))


@query(f"WITH {t.CUSTOMERS}, g AS (SELECT idx // 10 AS gid, min(c_acctbal) AS low, max(c_acctbal) AS high FROM c GROUP BY 1) SELECT gid, CASE WHEN high > 9900 THEN 0 WHEN low < -900 THEN 1 WHEN high < 9000 THEN 2 ELSE -1 END AS ended, NOT (high <= 9900 AND low < -900) AS output FROM g")
def done_and_stopped(spark: SparkSession, d: str) -> DataFrame:
    """Substeps that end early: with their output, without it, or with it at the third statement."""
    ts = t.customers(spark, d).group_by(10)
    values = ts.members.join(ts.targets, "idx").groupBy("gid").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    return ts.run_statements(values, ("done_if", F.col("high") > 9900), ("stop_if", F.col("low") < -900), ("done_if", F.col("high") < 9000)).na.fill(-1, ["ended"])


@query(f"WITH {t.PARTS} SELECT idx // 7 AS gid, idx % 7 AS pos, idx FROM p")
def group_auto(spark: SparkSession, d: str) -> DataFrame:
    """``auto`` keeps the groups that are there; ``None`` drops them."""
    ts = t.parts(spark, d).group_by(7).group_by("auto")
    assert ts.group_by(None).groups is None
    return _members(ts)
