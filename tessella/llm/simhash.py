"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ
in at most three bits differ in at most three bytes, so they share at least
five positional bytes: that count is the filter.  Posting lists of a single
byte would hold 1/256 of all documents each, so lists are intersected in
advance: the index is keyed by four positional bytes at a time.  The fourteen
position sets of ``POSITION_SETS`` are chosen so that any five positions
contain one of them; no pair that reaches the count is missed.  For the pairs
met in a posting list the shared positional bytes are tallied, pairs under
five are dropped, and the rest are verified by counting differing bits.

Posting lists longer than ``MAX_LIST`` (many near copies share their bytes)
are split by further bits that any linked pair must also share in part: the
remaining bits are cut into four fields, of which three differing bits leave
one equal.  After the last split at most 2**14 different fingerprints can
share a list, so no list is unbounded and none is cut short.  Within a list
only the edges of a spanning forest are returned, never all pairs.

Exact copies share one fingerprint and are collapsed before the index is built.

Nulls and empty texts have no words: their fingerprint is zero and they are
linked like any other.  Rows without an id are kept but are no graph nodes;
their component is that of their fingerprint, null if it has no id at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import cut, free_name, slices, text_bytes
from tessella.llm.components import connected_components

#: Longest posting list that is compared pair by pair inside a task.
MAX_LIST = 2048

#: Bits of fingerprints that differ at most.
MAX_BITS = 3

#: Shared positional bytes that this guarantees.
MIN_SHARED = 8 - MAX_BITS

#: Shingles hashed at a time, so that memory does not follow a text's length.
_CHUNK = 1 << 16


def position_sets() -> list[tuple[int, ...]]:
    """Fourteen sets of four byte positions, one inside any five positions.

    Both halves (0-3, 4-7), and each pair of one half with a pair of the other
    from the same perfect matching: of five positions, four lie in one half,
    or three do, which hold one pair of each matching.
    """
    halves = (0, 1, 2, 3), (4, 5, 6, 7)
    matchings = [[[(h[0], h[k]), tuple(x for x in h[1:] if x != h[k])] for k in (1, 2, 3)] for h in halves]
    crossed = [(*a, *b) for left, right in zip(*matchings, strict=True) for a in left for b in right]
    return [*halves, *crossed]


POSITION_SETS = position_sets()


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text: see ``fingerprints``."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _CHUNK):
        part = words[start : start + _CHUNK + shingle - 1] if len(words) >= shingle else words
        parts = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every whole text over lower-cased word shingles, as a signed long.

    Words are runs of anything but ASCII white space; a text of fewer words
    than a shingle is one shingle; h is XXH64 with seed 42; a bit is set if
    over half of all h, repeats included, have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) if t else 0 for t in text_bytes(batch, text_col)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())]))


def _fields(fixed: int) -> list[int]:
    """Four masks that split the bits outside ``fixed`` into consecutive fields."""
    free = [b for b in range(64) if not fixed >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(free, 4)]


def _refinements() -> list[list[int]]:
    """By level: all masks of shared bits.  Each mask of a level refines into four of the next."""
    levels = [[_mask(p) for p in POSITION_SETS]]
    for _ in range(3):
        levels.append([m | f for m in levels[-1] for f in _fields(m)])
    return levels


_LEVELS = _refinements()


def _postings(rows: DataFrame, level: int, parent: Column | None = None) -> DataFrame:
    """(slot, bits, fp, node): ``rows`` under each of their keys of a level."""
    fp = F.col("fp")
    if level == 0:
        keys = F.array(*(F.struct(F.lit(i).alias("slot"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(_LEVELS[0])))
        return rows.select("fp", "node", F.explode(keys).alias("k")).select("k.slot", "k.bits", "fp", "node")
    masks = F.lit([_signed(m) for m in _LEVELS[level]])
    finer = rows.select("fp", "node", F.explode(F.transform(F.lit([0, 1, 2, 3]), lambda k: F.col("slot") * 4 + k)).alias("slot"))
    return finer.select("slot", fp.bitwiseAND(F.get(masks, F.col("slot"))).alias("bits"), "fp", "node")


def shared_bytes(front: np.ndarray, others: np.ndarray) -> np.ndarray:
    """[front, others]: the tally of positional bytes that each pair of fingerprints shares."""
    tally = np.zeros((len(front), len(others)), dtype=np.uint8)
    for at in range(8):
        shift = np.uint64(8 * at)
        tally += (front >> shift).astype(np.uint8)[:, None] == (others >> shift).astype(np.uint8)[None, :]
    return tally


def forest(fps: np.ndarray, max_bits: int = MAX_BITS, min_shared: int = MIN_SHARED, seen: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """Edges (index, index) that connect what is linked among the fingerprints of one list.

    Pairs are tallied first; the differing bits are counted of those alone
    whose tally reaches ``min_shared``.  ``seen`` counts both steps.
    """
    edges, left = [], np.arange(len(fps))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for start in range(0, len(front), 64):
                some = fps[front[start : start + 64]]
                a, b = np.nonzero(shared_bytes(some, fps[left]) >= min_shared)
                near = np.bitwise_count(some[a] ^ fps[left[b]]) <= max_bits
                hit[b[near]] = True
                if seen is not None:
                    seen["tallied"] = seen.get("tallied", 0) + len(some) * len(left)
                    seen["verified"] = seen.get("verified", 0) + len(a)
            front, left = left[hit], left[~hit]
            edges.extend((int(seed), int(i)) for i in front)
    return edges


def _links(postings: DataFrame, max_bits: int) -> DataFrame:
    """(src, dst): spanning edges of each posting list; every list lies in one partition, sorted."""
    schema = "src long, dst long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.empty(0, dtype=np.int64)] * 4

        def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
            slot, bits, fp, node = cols
            starts = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (bits[1:] != bits[:-1])]) if len(slot) else np.empty(0, dtype=int)
            sizes = np.diff(np.r_[starts, len(slot)])
            src, dst = [], []
            for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                for i, j in forest(fp[a : a + n].view(np.uint64), max_bits, 8 - max_bits):
                    src.append(node[a + i])
                    dst.append(node[a + j])
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

        for batch in batches:
            cols = [np.concatenate([t, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, t in enumerate(tail)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])  # the last list may go on
            tail = [c[last] for c in cols]
            yield emit([c[~last] for c in cols])
        yield emit(tail)

    return postings.repartition("slot", "bits").sortWithinPartitions("slot", "bits").mapInArrow(run, schema)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, max_list: int = MAX_LIST) -> DataFrame:
    """(src, dst) edges whose components are those of all pairs within ``max_bits`` bits.

    ``nodes``: (fp long, node long), fingerprints distinct.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the index guarantees pairs of at most {MAX_BITS} differing bits")
    found, rows, level = None, nodes, 0
    while True:
        postings = _postings(rows, level)
        long = None
        if level + 1 < len(_LEVELS):
            long = cut(postings.groupBy("slot", "bits").agg(F.count("*").alias("n")).where(F.col("n") > max_list))
            if long.isEmpty():
                long = None
        short = postings if long is None else postings.join(long, ["slot", "bits"], "left_anti")
        edges = _links(short, max_bits)
        found = edges if found is None else found.unionByName(edges)
        if long is None:
            return found.where("src <> dst").distinct()
        # A fingerprint may lie in several long lists: each goes on with its own slot.
        rows, level = postings.join(long.select("slot", "bits"), ["slot", "bits"], "left_semi").select("fp", "node", "slot"), level + 1


def _classes(prints: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """(fp, component_id) of every fingerprint; ``prints`` is a written table."""
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("node")))
    roots = connected_components(links(nodes.where(F.col("node").isNotNull()), max_bits))
    return nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: (id, fingerprint as 16 hex digits, component_id).

    ``component_id`` is the smallest id that links of at most ``max_bits``
    differing bits reach, itself included.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    return prints.join(_classes(prints, id_col, max_bits), "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: that with the smallest id.  Rows without an id are kept.

    Rows leave by id and text: of an id with two texts only that goes which
    has its like at a smaller id, and repeated rows of what stays all stay.
    """
    digest = free_name([*docs.columns, "fp", "component_id"], "_digest")
    texts = docs.select(id_col, text_col, F.xxhash64(text_col).alias(digest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) if t else 0 for t in text_bytes(batch, text_col)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(digest), pa.array(fps.view(np.int64))], [id_col, digest, "fp"])

    prints = cut(texts.mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField(digest, T.LongType()), T.StructField("fp", T.LongType())])))
    leavers = prints.join(_classes(prints, id_col, max_bits), "fp").where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_leaver"), F.col(digest).alias("_text")).distinct()
    return docs.join(leavers, (docs[id_col] == leavers["_leaver"]) & (F.xxhash64(docs[text_col]) == leavers["_text"]), "left_anti")
