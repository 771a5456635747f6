"""Collections on small literals: expectations are written out."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators.targets import Deferred, TargetSet, glob_regex


def names(n):
    return [f"a{i}.txt" for i in range(1, n + 1)]


def groups(ts):
    out = {r.gid: [] for r in ts.groups.collect()}
    for r in ts.listed().orderBy("gid", "pos").collect():
        out[r.gid].append(r.name)
    return [out[g] for g in sorted(out)]


def test_literal_scan_flattens_and_labels(spark):
    ts = TargetSet.of(spark, "x", ["y", ("z",)], {"A": ["p", "q"]}, B="r")
    assert [(r.idx, r.name, r.label) for r in ts.targets.orderBy("idx").collect()] == [(0, "x", ""), (1, "y", ""), (2, "z", ""), (3, "p", "A"), (4, "q", "A"), (5, "r", "B")]
    with pytest.raises(TypeError):
        TargetSet.of(spark, 3)


def test_chunks_pairs_and_pairwise(spark):
    ts = TargetSet.of(spark, names(6))
    assert groups(ts.group_by(4)) == [["a1.txt", "a2.txt", "a3.txt", "a4.txt"], ["a5.txt", "a6.txt"]]
    assert groups(ts.group_by("pairs")) == [["a1.txt", "a4.txt"], ["a2.txt", "a5.txt"], ["a3.txt", "a6.txt"]]
    assert groups(ts.group_by("pairs3")) == [["a1.txt", "a2.txt", "a3.txt", "a4.txt", "a5.txt", "a6.txt"]]
    assert groups(ts.group_by("pairwise"))[0] == ["a1.txt", "a2.txt"] and len(groups(ts.group_by("pairwise"))) == 5
    assert groups(ts.group_by("pairwise2")) == [["a1.txt", "a2.txt", "a3.txt", "a4.txt"], ["a3.txt", "a4.txt", "a5.txt", "a6.txt"]]
    assert groups(ts.group_by("single"))[5] == ["a6.txt"]


def test_combinations(spark):
    from itertools import combinations

    ts = TargetSet.of(spark, names(5))
    for k in (1, 2, 3, 4, 5):
        assert groups(ts.group_by(f"combinations{k}")) == [list(c) for c in combinations(names(5), k)]
    assert groups(TargetSet.of(spark, names(2)).group_by("combinations3")) == []


def test_all_and_single_of_nothing(spark):
    empty = TargetSet.of(spark)
    assert groups(empty.group_by("all")) == [[]]
    assert groups(empty.group_by("single")) == []
    assert groups(empty.group_by(3)) == []


@pytest.mark.parametrize("mode", [0, -1, "pairs0", "nonsense", "single2", True])
def test_bad_modes(spark, mode):
    with pytest.raises(ValueError):
        TargetSet.of(spark, names(4)).group_by(mode)


def test_uneven_pairs(spark):
    for mode, n in (("pairs", 5), ("pairs2", 6), ("pairwise4", 6)):
        with pytest.raises(ValueError):
            TargetSet.of(spark, names(n)).group_by(mode)


def test_labels_and_pairlabel(spark):
    ts = TargetSet.of(spark, B=["b1", "b2"], A=["a1", "a2", "a3", "a4"])
    assert groups(ts.group_by("label")) == [["b1", "b2"], ["a1", "a2", "a3", "a4"]]
    assert groups(ts.group_by("pairlabel")) == [["b1", "a1"], ["b1", "a2"], ["b2", "a3"], ["b2", "a4"]]
    assert groups(ts.group_by("pairlabel2")) == [["b1", "a1", "a2"], ["b2", "a3", "a4"]]
    with pytest.raises(ValueError):
        TargetSet.of(spark, A=["a"]).group_by("pairlabel")
    with pytest.raises(ValueError):
        TargetSet.of(spark, A=["a", "b"], B=["x", "y", "z"]).group_by("pairlabel")


def test_pairing(spark):
    ts = TargetSet.of(spark, names(3))
    assert [r.v for r in ts.paired_with("v", [7, 8, 9]).targets.orderBy("idx").collect()] == [7, 8, 9]
    for bad in (lambda: ts.paired_with("v", [1]), lambda: ts.group_by("single").group_with("v", [1, 2]), lambda: ts.with_attribute("name", F.lit(1)), lambda: ts.paired_with("v", 1).paired_with("v", [1, 2, 3])):
        with pytest.raises(ValueError):
            bad()
    assert [r.v for r in ts.group_with("v", ["x"]).groups.collect()] == ["x"]


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 4), st.integers(1, 3), st.integers(1, 3))
def test_loops_multiply(spark, n, a, b):
    ts = TargetSet.of(spark, names(n)).group_by("single").for_each({"x": list(range(a))}, {"y": list(range(b)), "z": list("abc"[:b])})
    rows = ts.groups.orderBy("gid").collect()
    assert [r.gid for r in rows] == list(range(n * a * b))
    assert [(r.x, r.y, r.z) for r in rows] == [(x, y, "abc"[y]) for y in range(b) for x in range(a) for _ in range(n)]
    assert ts.members.count() == n * a * b


def test_loop_lengths_must_agree(spark):
    with pytest.raises(ValueError):
        TargetSet.of(spark, names(2)).for_each({"x": [1], "y": [1, 2]})


def test_merging(spark):
    a, b = TargetSet.of(spark, "a1", "a2"), TargetSet.of(spark, "b1", "b2")
    assert groups(a.merge(b.group_by("single"))) == [["a1", "a2", "b1"], ["a1", "a2", "b2"]]
    assert groups(a.group_by("single").merge(b.group_by("all"))) == [["a1", "b1", "b2"], ["a2", "b1", "b2"]]
    assert groups(a.group_by("single").merge(b.group_by("single"))) == [["a1", "b1"], ["a2", "b2"]]
    assert groups(a.group_by("single").merge(b)) == [["a1", "b1", "b2"], ["a2", "b1", "b2"]]
    assert a.merge(b).groups is None
    with pytest.raises(ValueError):
        a.group_by("single").merge(TargetSet.of(spark, "x", "y", "z").group_by("single"))
    merged = a.group_by("single").group_with("v", [1, 2]).merge(b.group_by("single").group_with("v", [3, 4]))
    assert sorted(r.v for r in merged.groups.collect()) == [3, 4]


def test_selection_keeps_empty_groups(spark):
    ts = TargetSet.of(spark, A=["a", "b"], B=["c"]).group_by("single").select("A")
    assert groups(ts) == [["a"], ["b"], []]
    assert groups(ts.remove_empty_groups()) == [["a"], ["b"]]
    assert [r.idx for r in ts.targets.orderBy("idx").collect()] == [0, 1]


def test_positions_and_slices(spark):
    ts = TargetSet.of(spark, names(5))
    picked = lambda x: [r.name for r in ts.select(x).targets.orderBy("idx").collect()]
    assert picked([3, 0]) == ["a4.txt", "a1.txt"]
    assert picked(-1) == ["a5.txt"]
    assert picked(slice(1, 3)) == ["a2.txt", "a3.txt"]
    assert picked(slice(None, None, 2)) == ["a1.txt", "a3.txt", "a5.txt"]


def test_repetitions_leave_later_groups(spark):
    ts = TargetSet.of(spark, "a", "b", "a", "c").group_by(2).first_of_name()
    assert groups(ts) == [["a", "b"], ["c"]]


def test_active(spark):
    ts = TargetSet.of(spark, names(5)).group_by("single")
    gids = lambda x: sorted(r.gid for r in ts.active(x).collect())
    assert gids(True) == [0, 1, 2, 3, 4] and gids(False) == []
    assert gids(-1) == [4] and gids([0, -2]) == [0, 3] and gids(slice(1, 4, 2)) == [1, 3] and gids(slice(None, None, -2)) == [0, 2, 4]


def test_attribute_levels(spark):
    ts = TargetSet.of(spark, "a", "b").paired_with("v", ["1", None]).group_by("all")
    assert ts.substep_values(["v", "w"]).first()[1:] == (["1", None], [])
    assert ts.group_with("v", ["g"]).substep_values(["v"]).first().v == ["g"]
    assert ts.group_with("v", ["g"]).with_set_attribute("v", "s").substep_values(["v"]).first().v == ["s"]


def test_glob_and_deferred(spark):
    files = spark.createDataFrame([("/d/b.txt",), ("/d/a.txt",), ("/d/e/c.txt",), ("/d/x.csv",)], "path string")
    found = TargetSet.glob(files, "/d/*.txt")
    assert [r.name for r in found.targets.orderBy("idx").collect()] == ["/d/a.txt", "/d/b.txt"]
    with pytest.raises(FileNotFoundError):
        TargetSet.glob(files, "/z*", must_exist=True)
    assert Deferred(lambda: found).resolve() is found
    assert glob_regex("[!a]?*.b") == r"^[^a][^/][^/]*\.b$"


def test_null_labels_and_names(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", "L"), (3, "x", None)], "k long, n string, l string")
    ts = TargetSet.from_table(df, "n", "k", "l").group_by("label")
    assert groups(ts) == [[None, "x"], ["x"]]
