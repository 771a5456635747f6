"""Steps whose memory or time grew faster than their input."""

import json
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessella.functions import ordinal
from tessella.operators import grouping, targets
from tessella.operators.targets import TargetSet
from tessella.plans import groups, reading
from tessella.sources import files
from tests.conftest import DATA


def executed(df):
    """The rows, and the plan after adaptive execution."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_many_keys_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(k, i) for k in ("a", "b", "c", None) for i in range(5)], "k string, i long")
    for few, broadcast in ((3, False), (4, True)):
        monkeypatch.setattr(ordinal, "FEW_KEYS", few)
        rows, plan = executed(ordinal.with_rank_in(df, "k", "i"))
        assert sorted((str(r.k), r.i, r["rank"]) for r in rows) == sorted((str(k), i, i) for k in ("a", "b", "c", None) for i in range(5))
        assert ("Broadcast" in plan) == broadcast
    assert "Broadcast" not in executed(ordinal.with_previous(df, "k", "i", values={"before": "i"}))[1]


def test_lists_of_orders_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ordinal, "FEW_KEYS", 10)
    assert "Broadcast" not in executed(groups.group_lists(spark, str(DATA)))[1]


def numbered(spark, n):
    """Targets of one partition, as small tables are read."""
    return spark.range(0, n, 1, 1).select(F.col("id").alias("idx"))


@pytest.mark.parametrize("n, k", [(9, 2), (8, 3), (7, 4), (2, 2), (3, 3), (5, 1), (1, 2)])
def test_combinations_in_stretches(spark, monkeypatch, n, k):
    monkeypatch.setattr(grouping, "STRETCH", 3)
    monkeypatch.setattr(grouping, "PER_TASK", 4)
    members, made = grouping.group(numbered(spark, n), f"combinations{k}")
    expected = list(combinations(range(n), k))
    assert sorted(tuple(r) for r in members.collect()) == [(g, p, i) for g, c in enumerate(expected) for p, i in enumerate(c)]
    assert made.count() == len(expected)


def test_combinations_are_dealt_evenly(spark):
    members, _ = grouping.group(numbered(spark, 4000), "combinations2")
    sizes = [r["count"] for r in members.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 * 3999 and len(sizes) == 2 and max(sizes) < 0.6 * sum(sizes)


def test_combinations_in_tiles(spark, monkeypatch, tmp_path):
    """Tiles of all shapes, in one task or many; written, a row takes less than three bytes, as a task repeats few values."""
    for stretch, high, per_task in ((1, 1, 1), (2, 3, 5), (3, 2, 4), (4, 100, 7), (100, 4, 1000)):
        monkeypatch.setattr(grouping, "STRETCH", stretch)
        monkeypatch.setattr(grouping, "HIGH", high)
        monkeypatch.setattr(grouping, "PER_TASK", per_task)
        for n, k in ((10, 2), (8, 3), (7, 4), (4, 4)):
            made = sorted(tuple(r) for r in grouping.group(numbered(spark, n), f"combinations{k}")[0].collect())
            assert made == [(g, p, i) for g, c in enumerate(combinations(range(n), k)) for p, i in enumerate(c)]
    monkeypatch.undo()
    grouping.group(numbered(spark, 3000), "combinations2")[0].write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000 * 2999
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 3 * 3000 * 2999


def placed(ts):
    """Names by group and position, listed and joined by hand."""
    rows = sorted((r.gid, r.pos, r.name) for r in ts.listed().collect())
    assert rows == sorted((r.gid, r.pos, r.name) for r in ts.members.join(ts.targets, "idx").collect())
    return rows


LONE, SEVERAL = ["a", "b", "c"], [["x", "y"], ["z"], [], ["x"]]


def sides(spark):
    return TargetSet.of(spark, LONE), TargetSet.of(spark, "x", "y", "z").group_by([[0, 1], [2], [], [0]])


def expected(lone_first):
    return sorted((g, p, n) for g, own in enumerate(SEVERAL) for p, n in enumerate(LONE + own if lone_first else own + LONE))


def repeated(spark, monkeypatch, make, lone_first):
    """The repeated group meets the others in one task or many, either side broadcast or none; names are joined before."""
    for per_task, most in ((4_000_000, 500_000), (2, 500_000), (2, 3), (2, 1)):
        monkeypatch.setattr(targets, "PER_TASK", per_task)
        monkeypatch.setattr(targets, "MOST_BROADCAST", most)
        assert placed(make(*sides(spark))) == expected(lone_first)
    monkeypatch.undo()
    many = TargetSet(spark.range(0, 2500, 1, 1).selectExpr("id AS idx", "'file' AS kind", "'n' || id AS name", "'' AS label"))
    listed = make(many, many.group_by("single")).listed()
    sizes = [r["count"] for r in listed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 2500 * 2501 and max(sizes) < 0.6 * sum(sizes)


def test_merge_1n_is_spread(spark, monkeypatch):
    repeated(spark, monkeypatch, lambda lone, several: lone.group_by("all").merge(several), True)


def test_merge_0n_is_spread(spark, monkeypatch):
    repeated(spark, monkeypatch, lambda lone, several: lone.merge(several), True)


def test_merge_n1_is_spread(spark, monkeypatch):
    repeated(spark, monkeypatch, lambda lone, several: several.merge(lone.group_by("all")), False)


@pytest.mark.parametrize("lone_first", [True, False])
def test_repeats_are_made_in_tiles(spark, monkeypatch, tmp_path, lone_first):
    """Stretches of groups over several tasks; written, a row takes less than a byte, as a task repeats few values."""
    make = lambda lone, several: lone.merge(several) if lone_first else several.merge(lone)
    for per_task, stretch in ((2, 1), (2, 2), (6, 2), (7, 3), (100, 1)):
        monkeypatch.setattr(targets, "PER_TASK", per_task)
        monkeypatch.setattr(targets, "STRETCH", stretch)
        assert placed(make(*sides(spark))) == expected(lone_first)
    monkeypatch.undo()
    many = lambda n: TargetSet(spark.range(0, n, 1, 3).selectExpr("id AS idx", "'file' AS kind", "'n' || id AS name", "'' AS label"))
    listed = make(many(100), many(30000).group_by("single")).listed()
    listed.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30000 * 101
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 30000 * 101


@pytest.mark.parametrize("lone_first", [True, False])
def test_repeats_are_not_held(spark, monkeypatch, lone_first):
    """A broadcast makes all rows of a stretch before it hands on the first: it takes few members."""
    monkeypatch.setattr(targets, "STRETCH", 10)
    monkeypatch.setattr(targets, "MOST_BROADCAST", 50)
    several = TargetSet.of(spark, *(f"x{i}" for i in range(25))).group_by("single")
    for n, broadcast in ((5, True), (6, False)):
        lone = TargetSet.of(spark, *(f"n{i}" for i in range(n))).group_by("all")
        rows, plan = executed((lone.merge(several) if lone_first else several.merge(lone)).listed())
        names = [f"n{i}" for i in range(n)]
        assert sorted((r.gid, r.pos, r.name) for r in rows) == sorted((g, p, x) for g in range(25) for p, x in enumerate([*names, f"x{g}"] if lone_first else [f"x{g}", *names]))
        assert ("BroadcastNestedLoopJoin" in plan) == broadcast


def test_members_and_targets_are_not_broadcast(spark, monkeypatch):
    """Only the packed groups are, of which there are few."""
    monkeypatch.setattr(targets, "FEW_KEYS", 3, raising=False)
    monkeypatch.setattr(targets, "STRETCH", 2)
    monkeypatch.setattr(targets, "MOST_BROADCAST", 1)
    lone, several = sides(spark)
    for ts in (lone.merge(several), lone.group_by("all").merge(several), several.merge(lone.group_by("all")), several.merge(several), several):
        assert "Broadcast" not in executed(ts.listed())[1]


def test_notebooks_stay_small(spark, monkeypatch, tmp_path):
    """More customers give more notebooks, not longer ones."""
    monkeypatch.setattr(reading, "KEYS_PER_BOOK", 50)
    monkeypatch.setattr(reading, "_folder", lambda spark: str(tmp_path / "books"))
    found = reading.notebook_cells(spark, str(DATA))
    n = spark.read.parquet(f"{DATA}/customer.parquet").where("c_custkey % 3 <> 0").count()
    assert found.count() == n
    cells = [len(json.loads(f.read_text())["cells"]) for f in (tmp_path / "books").glob("part-*")]
    assert len(cells) > 25 and max(cells) <= 50


def test_notebooks_are_read_once(spark, tmp_path):
    """Lists, texts and odd characters of sources; a mark of byte order; several notebooks in a file."""
    book = lambda *sources: {"cells": [{"cell_type": "code", "metadata": {"kernel": "A"}, "source": s} for s in sources]}
    (tmp_path / "a.ipynb").write_text(json.dumps(book(["x = \"\u00e9\\n\"\n", "y"], [])), encoding="utf-8-sig")
    (tmp_path / "b.ipynb").write_text(json.dumps([book("p"), book(["q", "r"])]))
    found = files.notebook_cells(spark, str(tmp_path))
    assert sorted((r.file[-7:], r.ord, r.source) for r in found.collect()) == [("a.ipynb", 0, "x = \"\u00e9\\n\"\ny"), ("a.ipynb", 1, ""), ("b.ipynb", 0, "p"), ("b.ipynb", 0, "qr")]
    assert "FileScan json" not in found._jdf.queryExecution().executedPlan().toString()
