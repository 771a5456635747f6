import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella import shared
from tessella.functions import ordinal
from tessella.operators import dag, preview, provenance, steps, telemetry
from tessella.operators.ranges import in_ranges, named_like
from tessella.operators.targets import TargetSet


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_cycle_and_levels(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node_id string")
    edges = lambda *e: spark.createDataFrame([tuple(x) for x in e], "src string, dst string")
    assert pairs(dag.levels(nodes, edges("ab", "bc", "ad", "dc"))) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    with pytest.raises(dag.CycleError):
        dag.levels(nodes, edges("ab", "bc", "ca"))
    assert pairs(dag.reachable(edges("ab", "bc", "ca"), nodes.where("node_id = 'a'"))) == [("a", 0), ("b", 1), ("c", 2)]
    assert pairs(dag.blocked(edges("ab", "bc"), nodes.where("node_id = 'b'"))) == [("c",)]


def test_node_ids_are_unique(spark):
    nodes = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "step string, i int")
    assert dag.node_ids(nodes, ["step", "i"]).count() == 2


def test_signature_modes(spark):
    decisions = spark.createDataFrame([(1, "match"), (2, "target changed")], "step_id int, reason string")
    assert [r.step_id for r in provenance.to_run(decisions).collect()] == [2]
    assert provenance.to_run(decisions, "force").count() == 2 and provenance.to_run(decisions, "build").count() == 0
    with pytest.raises(PySparkException):
        provenance.to_run(decisions, "assert").collect()
    with pytest.raises(ValueError):
        provenance.to_run(decisions, "nonsense")


def test_freshness(spark):
    t = lambda *r: spark.createDataFrame(list(r), "k int, mtime int")
    assert pairs(provenance.later_than(t((1, 5), (2, 5), (3, 5)), t((1, 4), (2, 5), (4, 1)), "k")) == [(1, True), (2, False), (3, True), (4, False)]


def test_filters(spark):
    df = spark.createDataFrame([(0, 100), (50, 7), (None, None)], "mtime int, size int")
    now = F.lit(100)
    assert df.where(provenance.age_filter(F.col("mtime"), now, "60s")).count() == 1
    assert df.where(provenance.age_filter(F.col("mtime"), now, "-60s")).count() == 1
    assert df.where(provenance.size_filter(F.col("size"), 50)).count() == 1 and df.where(provenance.size_filter(F.col("size"), -50)).count() == 1
    with pytest.raises(ValueError):
        provenance.age_filter(F.col("mtime"), now, "old")
    steps = spark.range(12)
    assert [r.id for r in steps.where(in_ranges(F.col("id"), "3,5-6,-1,10-")).orderBy("id").collect()] == [0, 1, 3, 5, 6, 10, 11]
    with pytest.raises(ValueError):
        in_ranges(F.col("id"), "x")
    assert spark.createDataFrame([("a_10",), ("ab10",)], "n string").where(named_like(F.col("n"), "a_*")).count() == 1


def test_resources_must_agree(spark):
    tasks = spark.createDataFrame([(1, 10, 1, 1), (1, 20, 1, 1)], "b int, w int, m int, c int")
    with pytest.raises(PySparkException):
        telemetry.resources(tasks, "b", "w", "m", "c").collect()


def test_zap_and_latest(spark):
    files = spark.createDataFrame([("a", None), ("b", True)], "name string, zapped boolean")
    assert pairs(provenance.zap(files, F.col("name") == "a")) == [("a", True), ("b", True)]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, v int, s string")
    assert [tuple(r) for r in provenance.latest(rows, "k", "v").collect()] == [(1, 2, "y")]


def test_sortedness_and_samples(spark):
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    assert telemetry.is_sorted(rows, "id", "v") and not telemetry.is_sorted(rows.withColumn("v", -F.col("v")), "id", "v")
    assert sorted(r.id for r in telemetry.even_sample(rows, "id", 4).collect()) == [12, 37, 62, 87]
    assert telemetry.even_sample(rows, "id", 500).count() == 100


def test_series_without_x(spark):
    rows = spark.createDataFrame([(1, 5, None), (2, 6, "b")], "k int, y int, g string")
    assert pairs(preview.series(rows, None, ["y"], ["g"], ["k"])) == [("y|g=b", 1.0, 6.0), ("y|g=null", 0.0, 5.0)]
    assert preview.numeric_columns(rows) == ["k", "y"]
    assert preview.table(rows, ["k"], -1).count() == 2


def test_two_providers_are_an_error(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "target string")
    exact = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "target string, step string")
    assert sorted((r.target, r.step) for r in dag.providers(wanted, exact, []).collect()) == [("a", "x"), ("b", "y")]
    with pytest.raises(Exception, match="several steps provide b"):
        dag.providers(wanted, exact.unionByName(spark.createDataFrame([("b", "z")], exact.schema)), []).collect()
    with pytest.raises(ValueError):
        dag.providers(wanted, exact, [("{x}.b", "one"), ("{x}.b", "two")])


def test_resolve_stops(spark):
    io = spark.createDataFrame([("n", "input", "a.2")], "node_id string, role string, target string")
    none = spark.createDataFrame([], "target string, step string")
    files = spark.createDataFrame([("a.0",)], "target string")
    nodes, lost = dag.resolve(io, none, [("{x}.2", "two", ["{x}.1", "{x}.0"]), ("{x}.1", "one", ["{x}.0", "{x}.lost"])], files)
    assert sorted((r.node_id, r.role, r.target) for r in nodes.collect() if r.node_id != "n") == [("one|a.1", "input", "a.0"), ("one|a.1", "input", "a.lost"), ("one|a.1", "output", "a.1"), ("two|a.2", "input", "a.0"), ("two|a.2", "input", "a.1"), ("two|a.2", "output", "a.2")]
    assert [r.target for r in lost.collect()] == ["a.lost"]
    with pytest.raises(dag.CycleError):
        dag.resolve(io, none, [("{x}.2", "again", ["{x}{x}.2"])], files, most=3)


def test_levels_of_a_chain_and_a_circle(spark):
    chain = spark.range(12).selectExpr("id AS src", "id + 1 AS dst")
    nodes = spark.range(14).selectExpr("id AS node_id")
    assert {r.node_id: r.level for r in dag.levels(nodes, chain).collect()} == {**{i: i for i in range(13)}, 13: 0}
    assert {r.node_id: r.depth for r in dag.reachable(chain, nodes.where("node_id = 0")).collect()} == {i: i for i in range(13)}
    with pytest.raises(dag.CycleError):
        dag.levels(nodes, chain.unionByName(spark.createDataFrame([(12, 5)], "src long, dst long")))
    assert dag.levels(nodes.limit(0), chain.limit(0)).count() == 0


def test_previous_and_running_max_of_a_hot_key(spark):
    rows = [("hot", i, (i * 7919) % 101) for i in range(500)] + [("x", 1, 5), (None, 1, 3), (None, 2, 1)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    found = {(r.k, r.i): r.before for r in ordinal.with_previous(df, "k", "i", values={"before": "v"}).collect()}
    best = {(r.k, r.i): r.top for r in ordinal.with_running_max(df, "k", "i", value="v", name="top", stretch=37).collect()}
    for k in ("hot", "x", None):
        own = sorted((i, v) for key, i, v in rows if key == k)
        for n, (i, _) in enumerate(own):
            assert found[k, i] == (own[n - 1][1] if n else None) and best[k, i] == max(v for _, v in own[: n + 1])


def test_shared_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_output_from_errors(spark):
    out = spark.createDataFrame([("w_1", 0, "a", ""), ("w_5", 0, "b", "")], "step string, ord long, name string, label string")
    assert [r.name for r in steps.output_from(out, -1, current="w_7").targets.collect()] == ["b"]
    assert [r.name for r in steps.output_from(out, [5, "w_1"], current="w_7").targets.orderBy("idx").collect()] == ["b", "a"]
    for asked, current in ((-1, None), (-1, "w_1"), (-2, "w_5"), (True, "w_5")):
        with pytest.raises(ValueError):
            steps.output_from(out, asked, current=current)


def test_lists_of_positions(spark):
    ts = TargetSet.of(spark, "a", "b", "c")
    grouped = ts.group_by([[2, 0], [], [1, 1]])
    assert sorted((r.gid, r.pos, r.name) for r in grouped.listed().collect()) == [(0, 0, "c"), (0, 1, "a"), (2, 0, "b"), (2, 1, "b")] and grouped.groups.count() == 3
    for wrong in ([[3]], [[-1]]):
        with pytest.raises(Exception, match="no target of 3"):
            ts.group_by(wrong).listed().collect()
