"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over eight or fewer neighbouring tokens that reads five
of them and ignores the rest, so a hit survives substitutions at the ignored
places.  Test items and documents are hashed under every mask, the hashes are
joined, hits on one diagonal (document position minus item position) are put
together, and the whole diagonal is compared token by token.

A document leaks an item if, on some diagonal, ``WINDOW`` consecutive tokens of
the item hold at most ``MAX_SUBSTITUTIONS`` substitutions; an item shorter than
the window is compared whole, with proportionally fewer.  The two masks are
such that every such overlap has a seed hit (``tests/llm`` enumerate this), so
the result does not depend on the seeds.  Items under ``EXACT_TOKENS`` tokens
leave no room for substitutions: they match where all their tokens stand, and
have a mask that reads all of them.  Items without a token never match.

Tokens are runs of anything but ASCII white space, A-Z lower-cased.  Null and
empty texts have none.  Repeated items are matched each; repeated documents'
ids give one row.  Empty tables give no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: The token places that each seed reads.
MASKS = ((0, 1, 2, 4, 6), (0, 1, 3, 4, 5))
WINDOW = 13
MAX_SUBSTITUTIONS = 2
EXACT_TOKENS = 8

#: Seeds of the test side that are broadcast; beyond it both sides are shuffled by their hash.
BROADCAST_SEEDS = 1_000_000

#: Diagonals with hits whose documents are broadcast back to the texts; beyond it they are joined by id.
BROADCAST_DIAGONALS = 200_000


def tokens(text: Column) -> Column:
    """Array of tokens; empty for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(plain, "[ \\t-\\r]+"), lambda t: t != "")


def _seeds(toks: Column, masks: list[tuple[int, ...]]) -> Column:
    """Array of (place, seed hash) under all masks.  The token hashes are bound once, by a lambda."""

    def under(hashes: Column, mask: tuple[int, ...]) -> Column:
        number = sum(1 << k for k in mask)
        last = F.size(hashes) - mask[-1] - 1
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(number), *(F.get(hashes, i + k) for k in mask)).alias("seed")))

    bound = F.array(F.transform(toks, lambda t: F.xxhash64(t)))
    return F.flatten(F.transform(bound, lambda h: F.concat(*(under(h, m) for m in masks))))


def _allowed(n: Column) -> Column:
    """Substitutions allowed in an item of n tokens."""
    return F.when(n < EXACT_TOKENS, 0).otherwise(F.least(F.lit(MAX_SUBSTITUTIONS), F.floor(n * MAX_SUBSTITUTIONS / WINDOW))).cast("int")


def leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_tokens, n_matched, first_token): the leaked items of each document.

    ``n_tokens``: tokens of the item; ``n_matched``: those that the best
    diagonal of the document repeats; ``first_token``: where that diagonal's
    overlap starts in the document (ties: the first).
    """
    items = cut(tests.select(F.col(item_col).alias("_item"), tokens(F.col(item_text_col)).alias("_want")).where(F.size("_want") > 0).distinct())
    n = F.size("_want")
    short = sorted(r[0] for r in items.where(n < EXACT_TOKENS).select(n).distinct().collect())  # seven lengths at most
    whole = {k: tuple(range(k)) for k in short}
    of_item = F.when(n >= EXACT_TOKENS, _seeds(F.col("_want"), list(MASKS)))
    for k, mask in whole.items():
        of_item = of_item.when(n == k, _seeds(F.col("_want"), [mask]))
    seeds = items.select("_item", F.explode(of_item).alias("s")).select("_item", F.col("s.at").alias("_j"), "s.seed")
    n_tokens = items.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    if n_tokens * len(MASKS) <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where(F.col("_doc").isNotNull())
    placed = texts.select("_doc", F.explode(_seeds(tokens(F.col("_text")), [*MASKS, *whole.values()])).alias("s")).select("_doc", F.col("s.at").alias("_i"), "s.seed")
    hits = placed.join(seeds, "seed").select("_doc", "_item", (F.col("_i") - F.col("_j")).alias("_shift"))
    sizes = items.select("_item", n.alias("_n")).groupBy("_item").agg(F.max("_n").alias("_n"))
    if n_tokens * len(MASKS) <= BROADCAST_SEEDS:
        sizes = F.broadcast(sizes)
    diagonals = cut(hits.distinct().join(sizes, "_item").groupBy("_doc").agg(F.collect_set(F.struct("_item", "_shift", "_n")).alias("_on")))
    n_diagonals = diagonals.agg(F.coalesce(F.sum(F.size("_on")), F.lit(0))).first()[0]
    found = diagonals if n_diagonals > BROADCAST_DIAGONALS else F.broadcast(diagonals)
    # The tokens are bound once, by a lambda; each hit takes the stretch that its item can cover.
    stretch = lambda have, h: F.struct(h["_item"].alias("_item"), h["_shift"].alias("_shift"), F.slice(have, F.greatest(h["_shift"], F.lit(0)) + 1, h["_n"]).alias("_from"))
    near = texts.join(found, "_doc").select("_doc", tokens(F.col("_text")).alias("_have"), "_on")
    pairs = near.select("_doc", "_have", F.explode("_on").alias("h")).select("_doc", stretch(F.col("_have"), F.col("h")).alias("h"))
    return _verified(pairs.select("_doc", "h.*"), items, id_col, item_col)


def _verified(pairs: DataFrame, items: DataFrame, id_col: str, item_col: str) -> DataFrame:
    joined = pairs.join(items, "_item")
    lead = F.greatest(-F.col("_shift"), F.lit(0))
    same = F.transform(F.col("_want"), lambda t, j: F.when((j >= lead) & (t == F.get(F.col("_from"), j - lead)), 1).otherwise(0))
    n = F.size("_want")
    width = F.least(n, F.lit(WINDOW))

    def sums(flags: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - width), lambda s: F.aggregate(F.slice(flags, s + 1, width), F.lit(0), lambda a, x: a + x))

    best = F.array_max(F.flatten(F.transform(F.array(same), sums)))
    scored = joined.select("_doc", "_item", "_shift", n.alias("_n"), best.alias("_best"), F.aggregate(same, F.lit(0), lambda a, x: a + x).alias("_matched"), width.alias("_width"))
    kept = scored.where(F.col("_best") >= F.col("_width") - _allowed(F.col("_n")))
    top = kept.groupBy("_doc", "_item").agg(F.max(F.struct("_matched", (-F.greatest(F.col("_shift"), F.lit(0))).alias("_at"), "_n")).alias("m"))
    return top.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), F.col("m._n").cast("long").alias("n_tokens"), F.col("m._matched").cast("long").alias("n_matched"), (-F.col("m._at")).cast("long").alias("first_token"))


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that leak an item.  Rows without an id are kept."""
    leaking = leaks(docs, tests, id_col, text_col, item_col, item_text_col).select(id_col).distinct()
    return docs.join(leaking, id_col, "left_anti").select(docs.columns)
