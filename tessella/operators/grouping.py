"""The grouping modes: which target stands where in which group.

Targets are numbered without gaps, so most modes are arithmetic on the number
and need neither shuffle nor window.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessella.functions.ordinal import with_ordinal, with_rank_in

#: Combinations come in tiles of the last two positions: of the last one a stretch, of the one before it so many.  A task makes so many combinations.
STRETCH, HIGH, PER_TASK = 256, 64, 4_000_000


def group(targets: DataFrame, mode: str | int | list[list[int]] | DataFrame | Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of a mode: single, all, a size, label, pairs[N], pairwise[N], combinations[K], pairlabel[N], lists of positions, or a function of idx.

    The function gives a group number, null for none, or an array of them for
    targets that stand in several groups.  Lists of positions come as a table
    (gid, pos, idx) or, a few of them, as Python lists; groups may overlap.
    """
    if isinstance(mode, DataFrame):
        return by_lists(targets, mode)
    if isinstance(mode, (list, tuple)):
        rows = [(g, p, i) for g, positions in enumerate(mode) for p, i in enumerate(positions)]
        members, _ = by_lists(targets, targets.sparkSession.createDataFrame(rows, "gid long, pos long, idx long"))
        return members, _numbered(targets, len(mode))
    if callable(mode):
        return _by_function(targets, mode)
    if isinstance(mode, bool):
        raise ValueError("a grouping mode is a name or a size")
    text = str(mode)
    if re.fullmatch(r"-?\d+", text):
        return chunks(targets, int(text))
    m = re.fullmatch(r"(single|all|label|source|pairs|pairwise|combinations|pairlabel|pairsource)(\d*)", text)
    if not m or (m[2] and m[1] in ("single", "all", "label", "source")):
        raise ValueError(f"unknown grouping mode {mode!r}")
    size = int(m[2]) if m[2] else None
    if size == 0:
        raise ValueError("the size of a group is positive")
    name = {"source": "label", "pairsource": "pairlabel"}.get(m[1], m[1])
    if name in ("single", "all", "label"):
        return {"single": single, "all": everything, "label": by_label}[name](targets)
    return {"pairs": pairs, "pairwise": pairwise, "combinations": combinations, "pairlabel": pairlabel}[name](targets, size or (2 if name == "combinations" else 1))


def _numbered(targets: DataFrame, n: int) -> DataFrame:
    return targets.sparkSession.range(n).select(F.col("id").alias("gid"))


def _members(targets: DataFrame, gid: Column, pos: Column) -> DataFrame:
    return targets.select(gid.cast("long").alias("gid"), pos.cast("long").alias("pos"), "idx")


def single(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A group for each target."""
    return _members(targets, F.col("idx"), F.lit(0)), targets.select(F.col("idx").alias("gid"))


def everything(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One group, even of nothing."""
    return _members(targets, F.lit(0), F.col("idx")), _numbered(targets, 1)


def chunks(targets: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Groups of ``size`` neighbours; the last may be short."""
    if size <= 0:
        raise ValueError("the size of a group is positive")
    gid = F.floor(F.col("idx") / size)
    return _members(targets, gid, F.col("idx") % size), targets.where(F.col("idx") % size == 0).select(gid.cast("long").alias("gid"))


def by_label(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A group for each label, in the order in which labels first appear."""
    labels = with_ordinal(targets.groupBy("label").agg(F.min("idx").alias("first")), "first", name="gid")
    ranked = with_rank_in(targets.select("label", "idx"), "label", "idx", name="pos")
    return ranked.join(labels.select("label", "gid"), "label").select("gid", "pos", "idx"), labels.select("gid")


def pairs(targets: DataFrame, size: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first half against the second, in blocks of ``size``."""
    n = targets.count()
    if n % 2 or (n // 2) % size:
        raise ValueError(f"{n} targets make no pairs of blocks of {size}")
    half = n // 2
    place = F.col("idx") % half if half else F.col("idx")
    return _members(targets, F.floor(place / size), F.when(F.col("idx") >= half, size).otherwise(0) + place % size), _numbered(targets, half // size)


def pairwise(targets: DataFrame, size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Every block of ``size`` with the next one."""
    n = targets.count()
    if n % size:
        raise ValueError(f"{n} targets make no blocks of {size}")
    n_groups = max(0, n // size - 1)
    block = F.floor(F.col("idx") / size)
    both = targets.select("idx", F.explode(F.array(F.struct(block.alias("gid"), F.lit(0).alias("half")), F.struct((block - 1).alias("gid"), F.lit(1).alias("half")))).alias("s"))
    members = both.where(F.col("s.gid").between(0, n_groups - 1))
    return members.select(F.col("s.gid").cast("long").alias("gid"), (F.col("s.half") * size + F.col("idx") % size).cast("long").alias("pos"), "idx"), _numbered(targets, n_groups)


def _choose(n: Column, k: int) -> Column:
    """Binomial coefficients of a column, exact in longs."""
    out = F.lit(1).cast("long")
    for i in range(k):
        # The product of i + 1 neighbours is divisible by i + 1: `div` keeps longs.
        out = F.call_function("div", out * (n - i), F.lit(i + 1).cast("long")) if i else n.cast("long")
    return F.when(n >= k, out).otherwise(0)


def combinations(targets: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """All ``k``-subsets, numbered in lexicographic order of their positions."""
    n = targets.count()
    total = comb(n, k)
    if total >= 1 << 63:
        raise ValueError(f"{total} combinations cannot be numbered by longs")
    long = lambda x: F.lit(x).cast("long")
    if k == 1 or k > n:
        return _members(targets if k <= n else targets.limit(0), F.col("idx"), F.lit(0)), _numbered(targets, total)
    if k == 2:
        tiles = targets.where((F.col("idx") < n - 1) & (F.col("idx") % HIGH == 0)).select(F.array().cast("array<bigint>").alias("c"), F.col("idx").alias("i"))
    else:
        tiles = targets.where(F.col("idx") <= n - k).select(F.array("idx").alias("c"))
        for j in range(1, k - 2):
            tiles = tiles.select(F.explode(F.sequence(F.element_at("c", -1) + 1, long(n - (k - j)))).alias("x"), "c").select(F.array_append("c", F.col("x")).alias("c"))
        tiles = tiles.select("c", F.explode(F.sequence(F.element_at("c", -1) + 1, long(n - 2), long(HIGH))).alias("i"))
    # The last two positions are dealt in tiles, so that a task gets no more than its share however the first ones lie.
    tiles = tiles.select("c", "i", F.explode(F.sequence(F.floor((F.col("i") + 1) / STRETCH) * STRETCH, long(n - 1), long(STRETCH))).alias("x"))
    if total > PER_TASK:
        tiles = tiles.repartition(-(-total // PER_TASK))
    # A row of a tile: combinations that share all positions but the last, which goes from x on.
    own = tiles.select("c", "x", F.explode(F.sequence(F.col("i"), F.least(F.col("i") + HIGH, long(n - 1)) - 1)).alias("i"))
    own = own.select("c", "i", F.greatest(F.col("x"), F.col("i") + 1).alias("x"), F.least(F.col("x") + STRETCH, long(n)).alias("end")).where("x < end")
    first = [*(F.get("c", F.lit(j)) for j in range(k - 2)), F.col("i")]
    after = sum((_choose(n - 1 - e, k - j) for j, e in enumerate(first)), F.lit(0))
    # One position after the other: in a file the group numbers of a row repeat soon after, and the targets are runs.
    placed = own.select((total - 1 - after - (n - 1 - F.col("x"))).cast("long").alias("first"), *(e.alias(f"i{j}") for j, e in enumerate(first)), "x", (F.col("end") - F.col("x")).alias("size"), F.explode(F.sequence(long(0), long(k - 1))).alias("pos"))
    at = F.col("x")
    for j in range(k - 1):
        at = F.when(F.col("pos") == j, F.col(f"i{j}")).otherwise(at)
    placed = placed.select("first", "pos", at.alias("at"), F.when(F.col("pos") == k - 1, 1).otherwise(0).alias("by"), F.explode(F.sequence(long(0), F.col("size") - 1)).alias("step"))
    return placed.select((F.col("first") + F.col("step")).alias("gid"), "pos", (F.col("at") + F.col("by") * F.col("step")).alias("idx")), _numbered(targets, total)


def pairlabel(targets: DataFrame, size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Align labels: the largest gives ``size`` targets to each group, the others are cut or stretched to as many groups."""
    counts = targets.groupBy("label").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    n_labels, largest = counts.agg(F.count("*"), F.max("n")).first()
    if n_labels < 2:
        raise ValueError("pairlabel needs two labels or more")
    if largest % size:
        raise ValueError(f"{largest} targets make no blocks of {size}")
    g = largest // size
    uneven = counts.where(F.when(F.col("n") > g, F.col("n") % g).otherwise(g % F.col("n")) != 0).limit(1).collect()
    if uneven:
        raise ValueError(f"label {uneven[0]['label']!r} of {uneven[0]['n']} cannot be aligned with {g} groups")
    order = with_ordinal(counts, "first", name="ord").select("label", "n", "ord")
    ranked = with_rank_in(targets.select("label", "idx"), "label", "idx", name="r").join(order, "label")
    per = F.floor(F.col("n") / g)
    cut = F.col("n") > g
    own = F.when(cut, F.array(F.floor(F.col("r") / per))).otherwise(F.sequence(F.floor(F.col("r") * g / F.col("n")), F.floor((F.col("r") + 1) * g / F.col("n")) - 1))
    placed = ranked.select("label", "idx", "ord", "r", F.explode(own).alias("gid"), F.when(cut, F.col("r") % per).otherwise(0).alias("at"), F.when(cut, per).otherwise(1).alias("width"))
    widths = order.select(F.col("ord").alias("o"), F.when(F.col("n") > g, F.floor(F.col("n") / g)).otherwise(1).alias("w"))
    before = order.select("ord").join(widths, F.col("o") < F.col("ord"), "left").groupBy("ord").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("before"))
    return placed.join(before, "ord").select(F.col("gid").cast("long").alias("gid"), (F.col("before") + F.col("at")).cast("long").alias("pos"), "idx"), _numbered(targets, g)


def by_lists(targets: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups from lists of positions (gid, pos, idx); a position that no target has is an error, found when the rows are read."""
    n = targets.count()
    out = (F.col("idx") < 0) | (F.col("idx") >= n)
    # A value, no filter: Spark would carry a filter on idx over to the targets that idx is joined with.
    wrong = F.raise_error(F.concat(F.lit(f"no target of {n} has position "), F.coalesce(F.col("idx").cast("string"), F.lit("null")))).cast("long")
    checked = lists.select(F.col("gid").cast("long").alias("gid"), F.col("pos").cast("long").alias("pos"), F.when(F.coalesce(out, F.lit(True)), wrong).otherwise(F.col("idx").cast("long")).alias("idx"))
    last = lists.agg(F.coalesce(F.max("gid"), F.lit(-1)), F.coalesce(F.min("gid"), F.lit(0))).first()
    if last[1] < 0:
        raise ValueError("group numbers start at 0")
    return checked, _numbered(targets, last[0] + 1)


def _by_function(targets: DataFrame, make: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """A function of the position gives each target's group number or numbers (null: none)."""
    made = targets.select("idx", make(F.col("idx")).alias("gid"))
    if isinstance(made.schema["gid"].dataType, ArrayType):
        made = made.select("idx", F.explode("gid").alias("gid"))
    placed = made.select("idx", F.col("gid").cast("long").alias("gid")).where(F.col("gid").isNotNull())
    n = placed.agg(F.coalesce(F.max("gid"), F.lit(-1)), F.coalesce(F.min("gid"), F.lit(0))).first()
    if n[1] < 0:
        raise ValueError("group numbers start at 0")
    ranked = with_rank_in(placed, "gid", "idx", name="pos")
    return ranked.select("gid", "pos", "idx"), _numbered(targets, n[0] + 1)
