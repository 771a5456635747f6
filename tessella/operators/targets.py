"""Ordered, labelled, attributed collections of targets, with groups.

A collection is three tables: ``targets(idx, kind, name, label, attributes)``
with ``idx`` 0, 1, 2, ... in order; ``members(gid, pos, idx)``, which target
stands where in which group; and ``groups(gid, attributes)``, one row for each
group, the empty ones too.  Groups may overlap and need not cover everything.
Members are rows, not arrays, so that a group of any size stays spread out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ordinal import FEW_KEYS, with_ordinal, with_rank_in
from tessella.operators import grouping

#: Columns that attributes may not be named.
RESERVED = ("idx", "kind", "name", "label", "gid", "pos")

#: Where groups are repeated: rows that a task makes, rows of a stretch up to which members are broadcast, and groups of a stretch.
PER_TASK, MOST_BROADCAST, STRETCH = 4_000_000, 500_000, 1000


@dataclass(frozen=True)
class Deferred:
    """A collection whose content is only known when it is resolved."""

    make: Callable[[], TargetSet]

    def resolve(self) -> TargetSet:
        return self.make()


@dataclass(frozen=True)
class Part:
    """Members in rows (gid, pos, idx) and what repeats them; further columns of the rows go along."""

    rows: DataFrame
    spread: Callable[[DataFrame], DataFrame]


class Merged:
    """Members in parts, so that columns of targets are joined before the rows are repeated."""

    def __init__(self, parts: tuple[Part, ...]) -> None:
        self.parts = parts
        self.members = self.joined(lambda rows: rows)

    def joined(self, join: Callable[[DataFrame], DataFrame]) -> DataFrame:
        made = [part.spread(join(part.rows)) for part in self.parts]
        columns = ["gid", "pos", "idx", *(c for c in made[0].columns if c not in ("gid", "pos", "idx"))]
        return reduce(DataFrame.unionByName, [m.select(columns) for m in made])


@dataclass(frozen=True)
class TargetSet:
    targets: DataFrame
    members: DataFrame | None = None
    groups: DataFrame | None = None
    attributes: dict = field(default_factory=dict)
    #: How ``merge`` made the members; it holds as long as ``members`` are still these.
    merged: Merged | None = None

    # -- scans ---------------------------------------------------------------------------------

    @staticmethod
    def of(spark: SparkSession, *items, kind: str = "file", label: str = "", **labelled) -> TargetSet:
        """Literal targets: strings, nested iterables of them (flattened), and labelled ones by keyword or dict."""
        rows: list[tuple] = []

        def add(item: object, under: str) -> None:
            if isinstance(item, str):
                rows.append((len(rows), kind, item, under))
            elif isinstance(item, dict):
                for key, value in item.items():
                    add(value, key)
            elif isinstance(item, Iterable):
                for one in item:
                    add(one, under)
            else:
                raise TypeError(f"a target is a string or an iterable of them, not {type(item).__name__}")

        add(list(items), label)
        add(labelled, label)
        return TargetSet(spark.createDataFrame(rows, "idx long, kind string, name string, label string"))

    @staticmethod
    def from_table(df: DataFrame, name: str | Column, order: str | Sequence[str], label: str | Column | None = None, kind: str = "file", attributes: Sequence[str] = ()) -> TargetSet:
        """One target for each row, in the order of ``order`` (which should be total)."""
        order = [order] if isinstance(order, str) else list(order)
        text = F.col(name) if isinstance(name, str) else name
        shown = F.lit("") if label is None else F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit(""))
        rows = df.select(*(F.col(o).alias(f"_{i}") for i, o in enumerate(order)), F.lit(kind).alias("kind"), text.cast("string").alias("name"), shown.alias("label"), *attributes)
        return TargetSet(with_ordinal(rows, *(f"_{i}" for i in range(len(order)))).select("idx", "kind", "name", "label", *attributes))

    @staticmethod
    def glob(catalogue: DataFrame, pattern: str, must_exist: bool = False, label: str = "") -> TargetSet:
        """Paths of a file catalogue under a wildcard pattern, sorted; none is an error only if they must exist."""
        found = catalogue.where(F.col("path").rlike(glob_regex(pattern)))
        if must_exist and found.isEmpty():
            raise FileNotFoundError(f"nothing matches {pattern}")
        return TargetSet.from_table(found, "path", "path", F.lit(label))

    # -- attributes ----------------------------------------------------------------------------

    def with_attribute(self, name: str, value: Column) -> TargetSet:
        """A further attribute of each target; an existing name is an error."""
        if name in self.targets.columns or name in RESERVED:
            raise ValueError(f"the targets have a column {name} already")
        return replace(self, targets=self.targets.withColumn(name, value))

    def paired_with(self, name: str, values: object) -> TargetSet:
        """Pair targets with values by position: a scalar for all, a list, or a table (ord, value) of equal length."""
        if not isinstance(values, (list, tuple, DataFrame)):
            return self.with_attribute(name, F.lit(values))
        table = _value_table(self.targets.sparkSession, values)
        _same_length(self.targets.count(), table.count(), "paired_with")
        if name in self.targets.columns:
            raise ValueError(f"the targets have a column {name} already")
        return replace(self, targets=self.targets.join(table.select(F.col("ord").alias("idx"), F.col("value").alias(name)), "idx"))

    def group_with(self, name: str, values: object) -> TargetSet:
        """Pair groups with values by position; without groups all targets are one."""
        grouped = self if self.groups is not None else self.group_by("all")
        if not isinstance(values, (list, tuple, DataFrame)):
            return replace(grouped, groups=grouped.groups.withColumn(name, F.lit(values)))
        table = _value_table(self.targets.sparkSession, values)
        _same_length(grouped.groups.count(), table.count(), "group_with")
        return replace(grouped, groups=grouped.groups.join(table.select(F.col("ord").alias("gid"), F.col("value").alias(name)), "gid"))

    def with_set_attribute(self, name: str, value: object) -> TargetSet:
        """An attribute of the whole collection."""
        return replace(self, attributes={**self.attributes, name: value})

    def substep_values(self, names: Sequence[str]) -> DataFrame:
        """(gid, names): by group, the collection's value, else the group's, else the list of its targets' values.

        Lists keep the order of the group and hold null where a target has no value.
        """
        grouped = self if self.groups is not None else self.group_by("all")
        own = [n for n in names if n in self.targets.columns]
        lists = grouped.members.join(self.targets.select("idx", *own), "idx").groupBy("gid").agg(*(_ordered_list(n).alias(f"_{n}") for n in own)) if own else None
        out = grouped.groups if lists is None else grouped.groups.join(lists, "gid", "left")

        def value(n: str) -> Column:
            found = [F.array(F.lit(self.attributes[n]).cast("string"))] if n in self.attributes else []
            found += [F.when(F.col(n).isNotNull(), F.array(F.col(n).cast("string")))] if n in grouped.groups.columns else []
            found += [F.col(f"_{n}").cast("array<string>")] if n in own else []
            return F.coalesce(*found, F.array().cast("array<string>")).alias(n)

        return out.select("gid", *(value(n) for n in names))

    # -- groups --------------------------------------------------------------------------------

    def group_by(self, mode: str | int | list[list[int]] | DataFrame | None | Callable[[Column], Column]) -> TargetSet:
        """Groups by a mode of ``grouping``; earlier groups go, except with ``auto``."""
        if mode == "auto":
            return self
        if mode is None:
            return replace(self, members=None, groups=None)
        members, groups = grouping.group(self.targets, mode)
        return replace(self, members=members, groups=groups)

    def for_each(self, *loops: dict[str, list] | DataFrame) -> TargetSet:
        """Each loop multiplies the groups; the names inside a loop advance together; later loops are outermost."""
        out = self if self.groups is not None else self.group_by("all")
        for loop in loops:
            out = out._one_loop(loop)
        return out

    def _one_loop(self, loop: dict[str, list] | DataFrame) -> TargetSet:
        n_groups = self.groups.count()
        if isinstance(loop, DataFrame):
            # Rows of a table: its every row meets every group, which is what the operator returns.
            rows = loop.withColumnRenamed("ord", "_ord")
            n_values = rows.count()
            groups = self.groups.crossJoin(rows)
        else:
            lengths = {len(v) for v in loop.values()}
            if len(lengths) > 1:
                raise ValueError("the values of names that advance together differ in number")
            n_values = lengths.pop() if lengths else 0
            items = F.array(*(F.struct(F.lit(i).cast("long").alias("_ord"), *(F.lit(v[i]).alias(k) for k, v in loop.items())) for i in range(n_values)))
            groups = self.groups.select("*", F.explode(items).alias("_v")).select(*self.groups.columns, "_v.*")
        new = F.col("_ord") * n_groups + F.col("gid")
        groups = groups.withColumn("gid", new).drop("_ord")
        members = self.members.select("gid", "pos", "idx", F.explode(F.sequence(F.lit(0), F.lit(n_values - 1))).alias("_ord")).withColumn("gid", new).drop("_ord") if n_values else self.members.limit(0)
        return replace(self, members=members, groups=groups)

    def merge(self, other: TargetSet) -> TargetSet:
        """Append another collection.

        Groups 0 with N: the ungrouped targets join each of the N; 1 with N:
        the one is repeated; N with N: by position; else an error.  An other
        side without groups joins every group.  Its group attributes win.
        """
        offset = self.targets.count()
        shifted = other.targets.withColumn("idx", F.col("idx") + offset)
        targets = self.targets.unionByName(shifted, allowMissingColumns=True)
        if self.groups is None and other.groups is None:
            return replace(self, targets=targets)
        left = (self.members, self.groups) if self.groups is not None else None
        right = (other.members.withColumn("idx", F.col("idx") + offset), other.groups) if other.groups is not None else None
        if left is None:
            left = _one_group(self.targets)
        if right is None:
            right = _one_group(shifted, offset)
        n_left, n_right = left[1].count(), right[1].count()
        if n_left != n_right and 1 not in (n_left, n_right):
            raise ValueError(f"{n_left} groups cannot be merged with {n_right}")
        n = max(n_left, n_right)
        (lm, lg), (rm, rg) = left, right
        left_parts, right_parts = _parts(self, lm), _parts(other, rm, offset)
        if n_left != n:  # the left group stands before each of the right: its size is one number
            before, far = lm.count(), targets.sparkSession.range(n).select(F.col("id").alias("gid"))
            left_parts = [Part(p.rows, lambda df, p=p, over=_Over(far, n, before): over.each(p.spread(df))) for p in left_parts]
            right_parts = [Part(p.rows, lambda df, p=p: p.spread(df).withColumn("pos", F.col("pos") + before)) for p in right_parts]
            lg = _each(lg, n)
        elif n_right != n:
            sizes = targets.sparkSession.range(n).select(F.col("id").alias("gid")).join(_sizes(lm, n), "gid", "left").na.fill(0, ["_before"])
            over = _Over(sizes, n, rm.count())
            right_parts = [Part(p.rows, lambda df, p=p: over.each(p.spread(df)).withColumn("pos", F.col("pos") + F.col("_before")).drop("_before")) for p in right_parts]
            rg = _each(rg, n)
        else:
            right_parts = [Part(p.rows, lambda df, p=p: p.spread(df).join(_sizes(lm, n), "gid", "left").withColumn("pos", F.col("pos") + F.coalesce("_before", F.lit(0))).drop("_before")) for p in right_parts]
        merged = Merged((*left_parts, *right_parts))
        clashing = [c for c in lg.columns if c in rg.columns and c != "gid"]
        groups = lg.drop(*clashing).join(rg, "gid", "full")
        return replace(self, targets=targets, members=merged.members, groups=groups, merged=merged)

    def remove_empty_groups(self) -> TargetSet:
        """Without the groups that hold no target; the rest keep their order and are numbered anew."""
        full = self.groups.join(self.members, "gid", "left_semi")
        return self._renumbered(full)

    def _renumbered(self, groups: DataFrame) -> TargetSet:
        numbered = with_ordinal(groups, "gid", name="_new")
        members = self.members.join(numbered.select("gid", "_new"), "gid").select(F.col("_new").alias("gid"), "pos", "idx")
        return replace(self, members=members, groups=numbered.withColumn("gid", F.col("_new")).drop("_new"))

    # -- selections ----------------------------------------------------------------------------

    def select(self, what: str | int | slice | Sequence[int] | Column) -> TargetSet:
        """Targets by label, position, slice, positions in the order asked for, or condition.

        Labels and conditions keep all groups, even those that become empty;
        positions drop the groups.
        """
        if isinstance(what, Column):
            return self.where(what)
        if isinstance(what, str):
            return self.where(F.col("label") == what)
        if isinstance(what, bool):
            raise TypeError("a position is no truth value")
        n = self.targets.count() if isinstance(what, slice) or (isinstance(what, int) and what < 0) else None
        if isinstance(what, slice):
            what = list(range(n))[what] if what.step not in (None, 1) else range(*what.indices(n))
            if isinstance(what, range):
                kept = self.targets.where(F.col("idx").between(what.start, what.stop - 1))
                return TargetSet(kept.withColumn("idx", F.col("idx") - what.start), attributes=self.attributes)
        elif isinstance(what, int):
            what = [what + n if what < 0 else what]
        asked = self.targets.sparkSession.createDataFrame([(i, p) for i, p in enumerate(what)], "_new long, idx long")
        return TargetSet(self.targets.join(asked, "idx").withColumn("idx", F.col("_new")).drop("_new"), attributes=self.attributes)

    def where(self, condition: Column) -> TargetSet:
        """Targets under a condition, numbered anew; groups shrink but stay, with their attributes."""
        return replace(self, targets=self.targets.where(condition))._reindexed()

    def remove_kind(self, kind: str) -> TargetSet:
        return self.where(F.col("kind") != kind)

    def first_of_name(self) -> TargetSet:
        """Each name once, at its first place; later groups lose the repetition."""
        first = self.targets.groupBy("name").agg(F.min("idx").alias("idx"))
        keep = self.targets.join(first.select("idx"), "idx", "left_semi")
        return replace(self, targets=keep)._reindexed()

    def _reindexed(self) -> TargetSet:
        kept = with_ordinal(self.targets, "idx", name="_new")
        targets = kept.withColumn("idx", F.col("_new")).select(self.targets.columns)
        if self.groups is None:
            return replace(self, targets=targets)
        return replace(self, targets=targets, members=_closed_up(self.members.join(kept.select("idx", "_new"), "idx").select("gid", "pos", F.col("_new").alias("idx"))))

    def contains(self, names: DataFrame) -> DataFrame:
        """Those of ``names`` (column name) that the collection holds."""
        return names.join(self.targets.select("name").distinct(), "name", "left_semi")

    def without(self, other: TargetSet) -> TargetSet:
        """Targets whose name the other collection does not hold."""
        return replace(self, targets=self.targets.join(other.targets.select("name"), "name", "left_anti").select(self.targets.columns))._reindexed()

    def active(self, which: bool | int | slice | Sequence[int]) -> DataFrame:
        """gids of the groups that an ``active`` option admits; negative numbers count from the end."""
        gid, n = F.col("gid"), self.groups.count()
        if isinstance(which, bool):
            condition = F.lit(which)
        elif isinstance(which, int):
            condition = gid == (which + n if which < 0 else which)
        elif isinstance(which, slice):
            r = range(*which.indices(n))
            condition = (gid >= r.start) & (gid < r.stop) & ((gid - r.start) % r.step == 0) if r.step > 0 else gid.isin(list(r))
        else:
            condition = gid.isin([w + n if w < 0 else w for w in which])
        return self.groups.where(condition).select("gid")

    def skip(self, gids: DataFrame) -> TargetSet:
        """Groups whose substep is skipped lose their members and stay as empty groups."""
        return replace(self, members=self.members.join(gids, "gid", "left_anti"))

    def run_statements(self, values: DataFrame, *statements: tuple[str, Column]) -> DataFrame:
        """(gid, ended, output): after which statement each group's substep ended (null: it ran on), and whether its output stays.

        ``values``: (gid, ...) that the conditions read.  Statements in order:
        ``done_if`` ends a substep and keeps its output, ``stop_if`` and
        ``skip_if`` end it and drop the output; later statements do not see it.
        """
        ended, kept = F.lit(None).cast("int"), F.lit(True)
        for i in range(len(statements) - 1, -1, -1):
            kind, condition = statements[i]
            if kind not in ("done_if", "stop_if", "skip_if"):
                raise ValueError(f"unknown statement {kind!r}")
            hit = F.coalesce(condition, F.lit(False))
            ended, kept = F.when(hit, i).otherwise(ended), F.when(hit, kind == "done_if").otherwise(kept)
        return self.groups.select("gid").join(values, "gid", "left").select("gid", ended.alias("ended"), kept.alias("output"))

    def listed(self) -> DataFrame:
        """(gid, pos, idx, name, label) of every member."""
        # Members and targets are both all rows, and files of ordinals look small: neither is broadcast.
        shown = self.targets.select("idx", "name", "label").hint("merge")
        if self.merged is not None and self.merged.members is self.members:
            return self.merged.joined(lambda rows: rows.join(shown, "idx")).select("gid", "pos", "idx", "name", "label")
        return self.members.join(shown, "idx").select("gid", "pos", "idx", "name", "label")


def glob_regex(pattern: str) -> str:
    """The regex of a shell wildcard pattern, for a whole path."""
    import re

    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


def _ordered_list(name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", name))), lambda e: e[name])


def _value_table(spark: SparkSession, values: object) -> DataFrame:
    if isinstance(values, DataFrame):
        return values.select("ord", "value")
    if not values:
        return spark.createDataFrame([], "ord long, value string")
    return spark.createDataFrame(list(enumerate(values)), ["ord", "value"])


def _same_length(a: int, b: int, what: str) -> None:
    if a != b:
        raise ValueError(f"{what}: {b} values for {a}")


def _one_group(targets: DataFrame, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    spark = targets.sparkSession
    return targets.select(F.lit(0).cast("long").alias("gid"), (F.col("idx") - offset).alias("pos"), "idx"), spark.range(1).select(F.col("id").alias("gid"))


def _parts(ts: TargetSet, members: DataFrame, offset: int = 0) -> list[Part]:
    """The parts of a side of a merge, its own merges included; positions of its targets move by ``offset``."""
    if ts.merged is None or ts.merged.members is not ts.members:
        return [Part(members, lambda df: df)]
    return [Part(p.rows.withColumn("idx", F.col("idx") + offset), p.spread) for p in ts.merged.parts]


def _sizes(members: DataFrame, n: int) -> DataFrame:
    """Members of each of the ``n`` groups, not broadcast if they are many."""
    sizes = members.groupBy("gid").agg(F.count("*").alias("_before"))
    return sizes if n <= FEW_KEYS else sizes.hint("merge")


def _each(groups: DataFrame, n: int) -> DataFrame:
    """The one group (or none) as ``n``."""
    return groups.sparkSession.range(n).select(F.col("id").alias("gid")).crossJoin(F.broadcast(groups.drop("gid")))


@dataclass(frozen=True)
class _Over:
    """Repeats ``m`` members for each of the ``n`` groups of a table: every row meets every row, which is what a merge returns."""

    gids: DataFrame
    n: int
    m: int

    def each(self, members: DataFrame) -> DataFrame:
        """Tiles of members and stretches of groups: a task writes few values many times, which take next to no place in a file."""
        rows, stretch = members.drop("gid"), max(1, self.m * min(self.n, STRETCH))
        tall, wide = -(-stretch // PER_TASK), -(-self.n // (STRETCH * max(1, PER_TASK // stretch)))
        packed = self.gids.groupBy(F.floor(F.col("gid") / STRETCH).alias("_stretch")).agg(F.collect_list(F.struct(*self.gids.columns)).alias("_over"))
        if self.n <= STRETCH:
            met = (rows.repartition(tall) if tall > 1 else rows).crossJoin(F.broadcast(packed.select("_over")))
        else:
            stretches = packed.repartitionByRange(wide, "_stretch").select("_over")
            # A broadcast holds all rows of a stretch at once, so it takes few members; more are dealt, each part meets every stretch row by row.
            few = tall == 1 and stretch <= MOST_BROADCAST
            met = stretches.crossJoin(F.broadcast(rows)) if few else rows.repartition(tall).crossJoin(stretches.hint("shuffle_replicate_nl"))
        return met.select(*rows.columns, F.inline("_over"))


def _closed_up(members: DataFrame) -> DataFrame:
    """Positions of every group from 0 on, in the order that they had."""
    return with_rank_in(members, "gid", "pos", name="_pos").select("gid", F.col("_pos").alias("pos"), "idx")
