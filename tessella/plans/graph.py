"""Queries of dependencies.  Regions make nations, nations customers, customers orders: the keys are the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import dag
from tessella.plans import tables as t
from tessella.plans.query import query

_IO = """io AS (SELECT 'r' || r_regionkey AS node_id, 'output' AS role, 'R' || r_regionkey AS target FROM region
UNION ALL SELECT 'n' || n_nationkey, 'input', 'R' || n_regionkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 'output', 'N' || n_nationkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'input', 'N' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'output', 'C' || c_custkey FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'depends', 'C' || o_custkey FROM orders)"""
_EDGES = "e AS (SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM io a JOIN io b ON a.target = b.target AND a.role = 'output' AND b.role <> 'output' AND a.node_id <> b.node_id)"


def _io(spark: SparkSession, d: str) -> DataFrame:
    def rows(table: str, node: tuple[str, str], role: str, target: tuple[str, str]) -> DataFrame:
        return t.table(spark, d, table).select(F.concat(F.lit(node[0]), F.col(node[1]).cast("string")).alias("node_id"), F.lit(role).alias("role"), F.concat(F.lit(target[0]), F.col(target[1]).cast("string")).alias("target"))

    out = rows("region", ("r", "r_regionkey"), "output", ("R", "r_regionkey"))
    out = out.unionByName(rows("nation", ("n", "n_nationkey"), "input", ("R", "n_regionkey"))).unionByName(rows("nation", ("n", "n_nationkey"), "output", ("N", "n_nationkey")))
    out = out.unionByName(rows("customer", ("c", "c_custkey"), "input", ("N", "c_nationkey"))).unionByName(rows("customer", ("c", "c_custkey"), "output", ("C", "c_custkey")))
    return out.unionByName(rows("orders", ("o", "o_orderkey"), "depends", ("C", "o_custkey")))


@query(f"WITH {_IO}, {_EDGES} SELECT src, dst FROM e")
def dag_edges(spark: SparkSession, d: str) -> DataFrame:
    return dag.edges_by_target(_io(spark, d))


@query(f"WITH {_IO}, w AS (SELECT DISTINCT target FROM io WHERE role <> 'output') SELECT target, target IN (SELECT 'P' || p_partkey FROM part) AS \"exists\" FROM (SELECT DISTINCT 'P' || l_partkey AS target FROM lineitem UNION SELECT target FROM w) WHERE target NOT IN (SELECT target FROM io WHERE role = 'output')")
def dangling_targets(spark: SparkSession, d: str) -> DataFrame:
    """Wanted targets that no step makes: here parts, which exist as files."""
    wanted = t.table(spark, d, "lineitem").select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string")).alias("node_id"), F.lit("input").alias("role"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"))
    files = t.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("target"))
    return dag.dangling(_io(spark, d).unionByName(wanted), files)


@query("""SELECT DISTINCT s_name AS target, CASE WHEN s_suppkey % 10 = 0 THEN 'exact' WHEN regexp_full_match(s_name, 'Supplier#(.*)7') THEN 'seven' ELSE 'any' END AS step,
CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN regexp_full_match(s_name, 'Supplier#(.*)7') THEN regexp_extract(s_name, '^Supplier#(.+)7$', 1) ELSE regexp_extract(s_name, '#(.+)$', 1) END AS num FROM supplier""")
def provider_match(spark: SparkSession, d: str) -> DataFrame:
    """An exact provider first, then the first pattern that matches, with its wildcard."""
    suppliers = t.table(spark, d, "supplier")
    exact = suppliers.where("s_suppkey % 10 = 0").select(F.col("s_name").alias("target"), F.lit("exact").alias("step"))
    found = dag.providers(suppliers.select(F.col("s_name").alias("target")), exact, [("Supplier#{num}7", "seven"), ("{kind}#{num}", "any")])
    return found.select("target", "step", F.try_element_at("bindings", F.lit("num")).alias("num"))


@query(f"WITH {_IO}, {_EDGES}, s AS (SELECT DISTINCT node_id, CASE WHEN node_id LIKE 'r%' OR (node_id LIKE 'n%' AND CAST(substr(node_id, 2) AS INTEGER) % 2 = 0) THEN 'completed' ELSE 'pending' END AS status FROM io) SELECT node_id FROM s WHERE status = 'pending' AND node_id NOT IN (SELECT dst FROM e JOIN s ON src = node_id WHERE status <> 'completed')")
def ready_steps(spark: SparkSession, d: str) -> DataFrame:
    """Regions and even nations are done: odd nations, and customers of even ones, can run."""
    io = _io(spark, d)
    kind, number = F.substring("node_id", 1, 1), F.expr("CAST(substring(node_id, 2) AS INT)")
    nodes = io.select("node_id").distinct().withColumn("status", F.when((kind == "r") | ((kind == "n") & (number % 2 == 0)), "completed").otherwise("pending"))
    return dag.ready(nodes, dag.edges_by_target(io)).select("node_id")


@query(f"WITH RECURSIVE {_IO}, {_EDGES}, w AS (SELECT 'r0' AS node_id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node_id) SELECT node_id, min(depth) AS depth FROM w GROUP BY 1")
def reachable_steps(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the first region, and how far away it is."""
    return dag.reachable(dag.edges_by_target(_io(spark, d)), spark.createDataFrame([("r0",)], "node_id string"))


@query(f"WITH RECURSIVE {_IO}, {_EDGES}, w AS (SELECT 'o5' AS node_id, 0 AS depth UNION SELECT src, depth + 1 FROM w JOIN e ON dst = node_id) SELECT node_id, min(depth) AS depth FROM w GROUP BY 1")
def needed_steps(spark: SparkSession, d: str) -> DataFrame:
    """What an order needs: only its ancestors enter a plan for it."""
    return dag.reachable(dag.edges_by_target(_io(spark, d)), spark.createDataFrame([("o5",)], "node_id string"), backwards=True)


@query(f"WITH {_IO}, k AS (SELECT DISTINCT node_id FROM io) SELECT node_id, CASE substr(node_id, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 'c' THEN 2 ELSE 3 END AS level FROM k")
def step_levels(spark: SparkSession, d: str) -> DataFrame:
    io = _io(spark, d)
    return dag.levels(io.select("node_id"), dag.edges_by_target(io))


@query("SELECT 'n' || n_nationkey AS node_id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def blocked_by_failure(spark: SparkSession, d: str) -> DataFrame:
    """A failed region keeps everything under it from running."""
    return dag.blocked(dag.edges_by_target(_io(spark, d)), spark.createDataFrame([("r1",)], "node_id string"))


@query("SELECT DISTINCT a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate AND a.o_orderpriority = b.o_orderpriority")
def variable_edges(spark: SparkSession, d: str) -> DataFrame:
    """A customer is a workflow, orders its steps by date, the priority a variable that later steps use."""
    o = t.table(spark, d, "orders").select(F.col("o_custkey").alias("workflow"), F.col("o_orderkey").alias("node_id"), F.col("o_orderdate").alias("node_index"), F.array("o_orderpriority").alias("changed_vars"), F.array("o_orderpriority").alias("used_vars"))
    return dag.edges_by_variable(o)


@query("SELECT * FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS src, o_orderkey AS dst FROM orders) WHERE src IS NOT NULL")
def chained_steps(spark: SparkSession, d: str) -> DataFrame:
    """Default input: each step follows the one before it in its workflow."""
    return dag.edges_by_order(t.table(spark, d, "orders").select(F.col("o_custkey").alias("workflow"), F.col("o_orderkey").alias("node_id"), F.col("o_orderkey").alias("node_index")))


@query(f"WITH {_IO}, {_EDGES}, k AS (SELECT DISTINCT node_id FROM io) SELECT '\"' || node_id || '\" [color=green];' AS line FROM k UNION ALL SELECT '\"' || src || '\" -> \"' || dst || '\";' FROM e")
def graph_lines(spark: SparkSession, d: str) -> DataFrame:
    """A graph description of all nodes and edges."""
    io = _io(spark, d)
    return dag.to_dot(io.select("node_id").distinct().withColumn("status", F.lit("completed")), dag.edges_by_target(io))


@query("""WITH s AS (SELECT o_custkey AS wf, o_orderkey AS id, o_orderpriority AS v, o_orderkey % 3 = 0 AS u, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS src FROM orders)
SELECT src, id AS dst FROM s WHERE u AND src IS NOT NULL UNION SELECT a.id, b.id FROM s a JOIN s b ON a.wf = b.wf AND a.id < b.id AND a.v = b.v WHERE b.u""")
def undetermined_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every third order is a step whose input is not known yet; the priority is a variable."""
    key = F.col("o_orderkey")
    nodes = t.table(spark, d, "orders").select(F.col("o_custkey").alias("workflow"), key.alias("node_id"), key.alias("node_index"), F.array("o_orderpriority").alias("changed_vars"), F.array("o_orderpriority").alias("used_vars"), (key % 3 == 0).alias("undetermined"))
    return dag.edges_of_undetermined(nodes)


@query("""WITH w AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0)
SELECT 'want' || k AS node_id, 'input' AS role, 'b_' || k || '.idx' AS target FROM w
UNION ALL SELECT 'index|b_' || k || '.idx', 'output', 'b_' || k || '.idx' FROM w UNION ALL SELECT 'index|b_' || k || '.idx', 'input', 'b_' || k || '.bam' FROM w
UNION ALL SELECT 'align|b_' || k || '.bam', 'output', 'b_' || k || '.bam' FROM w UNION ALL SELECT 'align|b_' || k || '.bam', 'input', 'b_' || k || '.fq' FROM w""")
def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    """Indexes are wanted, made from alignments, made from reads, which are there: two rounds add all nodes."""
    io, files = _wanted(spark, d)
    return dag.resolve(io, _no_exact(spark), [("{base}.idx", "index", ["{base}.bam"]), ("{base}.bam", "align", ["{base}.fq"])], files)[0]


@query("SELECT 'b_' || o_orderkey || '.fq' AS target FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 = 0")
def unresolved_targets(spark: SparkSession, d: str) -> DataFrame:
    """Reads that are not there and that no step makes."""
    io, files = _wanted(spark, d)
    lost = files.where(F.regexp_extract("target", r"_(\d+)", 1).cast("bigint") % 5 != 0)
    return dag.resolve(io, _no_exact(spark), [("{base}.idx", "index", ["{base}.bam"]), ("{base}.bam", "align", ["{base}.fq"])], lost)[1]


def _wanted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey").cast("string")
    own = t.table(spark, d, "orders").where("o_orderkey % 2 = 0")
    return own.select(F.concat(F.lit("want"), k).alias("node_id"), F.lit("input").alias("role"), F.concat(F.lit("b_"), k, F.lit(".idx")).alias("target")), own.select(F.concat(F.lit("b_"), k, F.lit(".fq")).alias("target"))


def _no_exact(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "target string, step string")


_AFTER = "SELECT 'r' || r_regionkey AS node_id, CASE WHEN r_regionkey = 1 THEN '{failed}' ELSE 'completed' END AS status FROM region UNION ALL SELECT 'n' || n_nationkey, {nation} FROM nation UNION ALL SELECT 'c' || c_custkey, {other} FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'o' || o_orderkey, {other} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _after(spark: SparkSession, d: str, mode: str) -> DataFrame:
    io = _io(spark, d)
    nodes = io.select("node_id").distinct().withColumn("status", F.when(F.col("node_id").startswith("r"), "completed").otherwise("pending"))
    return dag.after_failure(nodes, dag.edges_by_target(io), spark.createDataFrame([("r1",)], "node_id string"), mode)


@query(_AFTER.format(failed="failed", nation="CASE WHEN n_regionkey = 1 THEN 'blocked' ELSE 'pending' END", other="CASE WHEN n_regionkey = 1 THEN 'blocked' ELSE 'pending' END"))
def failure_default(spark: SparkSession, d: str) -> DataFrame:
    """What does not depend on the failed region goes on."""
    return _after(spark, d, "default")


@query(_AFTER.format(failed="failed", nation="'aborted'", other="'aborted'"))
def failure_abort(spark: SparkSession, d: str) -> DataFrame:
    return _after(spark, d, "abort")


@query(_AFTER.format(failed="ignored", nation="'pending'", other="'pending'"))
def failure_ignore(spark: SparkSession, d: str) -> DataFrame:
    return _after(spark, d, "ignore")


@query("SELECT o_orderkey AS node_id, array_to_string(list_sort(list_distinct([o_orderpriority, 'common', o_orderstatus, 'common'])), ',') AS used_vars FROM orders")
def variables_used(spark: SparkSession, d: str) -> DataFrame:
    """All variables of a step, each once, sorted."""
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.array("o_orderpriority", F.lit("common")).alias("used"), F.array("o_orderstatus").alias("accessed"), F.array(F.lit("common")).alias("parameters"))
    return dag.variables_used(o).select("node_id", F.array_join("used_vars", ",").alias("used_vars"))


@query("SELECT DISTINCT md5(CAST(o_custkey AS VARCHAR) || chr(31) || o_orderpriority) AS node_id FROM orders")
def step_identities(spark: SparkSession, d: str) -> DataFrame:
    """Equal steps are one node."""
    return dag.node_ids(t.table(spark, d, "orders").select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"]).select("node_id")
