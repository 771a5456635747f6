"""Line dedup over content-defined chunks of lines.

A text is split at \n into lines; lines without a word count for nothing.  A
rolling hash over the hashes of two neighbouring lines decides, at every gap,
whether a chunk ends there: a gap whose rolling hash occurs once in the whole
corpus is a boundary.  The choice depends on the two lines alone, so lines that
are put in, changed or taken out elsewhere shift no boundary.  What lies
between two boundaries is a chunk; a chunk of several lines consists of
repeated pairs of lines, in their order.

Boundaries by a residue of the rolling hash miss passages: the chunks at both
ends of a passage then merge with the lines around it, and a passage of few
lines holds no whole chunk.  ``README.md`` gives the figures.

Multi-line chunks are removed wherever they occur again (at a larger id, or
later in the text) once the bytes of all pairs of a hash have been compared.  A
line of ``long_line`` words or more is a passage by itself and goes likewise,
though it is no chunk of several lines; ``long_line=None`` leaves such lines.
Every line that goes has an equal one at an earlier place, and the first of
all places is in no repeat, so no line is lost from the corpus.

Only hashes are shuffled to find repeats, each counted on the map side first;
the repeats are written before they are joined back, so that adaptive execution
splits a pair of lines that a third of all documents share.  Texts move once, by
id; the bytes of repeated pairs are made distinct on the map side before they
move.

Null texts stay null, empty ones empty.  Rows without an id are returned as
they are and count for nothing.  Repeated rows of one id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import cut, free_name, slices, text_bytes, without

#: A line of so many words is a passage of its own.
LONG_LINE = 50

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ALONE = np.uint64(0xD6E8FEB86659FD93)


def seen_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """The lines of a text, and the numbers of those with a word."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x and not x.isspace()]


def _is_long(line: bytes, long_line: int | None) -> bool:
    return long_line is not None and len(line) >= 2 * long_line - 1 and len(line.split()) >= long_line


def _digest(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def keys(lines: list[bytes], long_line: int | None = LONG_LINE) -> tuple[np.ndarray, np.ndarray]:
    """(keys, at) of lines with words: the 128-bit rolling hash of each and the next, and after them those of long lines alone (at < 0: ~at)."""
    n = len(lines)
    digests = np.frombuffer(b"".join(map(_digest, lines)), dtype=">u8").astype(np.uint64).reshape(n, 2)
    pairs = (digests[:-1] * _MIX + digests[1:]) * _MIX
    pairs ^= pairs >> np.uint64(29)
    long = [i for i, x in enumerate(lines) if _is_long(x, long_line)]
    alone = (digests[long] ^ _ALONE) * _MIX
    at = np.r_[np.arange(max(0, n - 1)), [~i for i in long]].astype(np.int32)
    return np.concatenate([pairs, alone]).view(np.int64), at


def _held(lines: list[bytes], which: list[int], marks: list[dict]) -> list[tuple[dict, bytes]]:
    """(mark, bytes) of the marks that a text bears out; others belong to another text of its id."""
    out = []
    for m in marks:
        i = m["at"]
        run = [lines[which[k]] for k in ((~i,) if i < 0 else (i, i + 1)) if k < len(which)]
        if len(run) == 1 + (i >= 0):
            k, _ = keys(run, 0 if i < 0 else None)
            if tuple(k[0].tolist()) == (m["k1"], m["k2"]):
                out.append((m, b"\n".join(run)))
    return out


def _pair_keys(docs: DataFrame, id_col: str, text_col: str, long_line: int | None) -> DataFrame:
    """(id, k1, k2, at, again): every pair of neighbouring lines of a document; again: it occurred before in the text."""
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL("k1 long, k2 long, at int, again boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found, at, again = [], [np.empty((0, 2), np.int64)], [np.empty(0, np.int32)], []
            for r, text in enumerate(text_bytes(batch, text_col)):
                lines, which = seen_lines(text) if text else ([], [])
                if not which:
                    continue
                k, a = keys([lines[i] for i in which], long_line)
                had: set[tuple] = set()
                for key in map(tuple, k.tolist()):
                    again.append(key in had)
                    had.add(key)
                rows.append(np.full(len(a), r, np.int32))
                found.append(k)
                at.append(a)
            k = np.concatenate(found)
            rows = np.concatenate(rows) if rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows)), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(np.concatenate(at)), pa.array(again, pa.bool_())], [id_col, "k1", "k2", "at", "again"])

    return docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(run, schema)


def _marked_bytes(marked: DataFrame, text_col: str, column: str) -> DataFrame:
    """(k1, k2, run): the bytes of each marked pair or long line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[tuple[int, int, bytes], None] = {}
            for text, marks in zip(text_bytes(batch, text_col), batch.column(column).to_pylist(), strict=True):
                if text:
                    found |= {(m["k1"], m["k2"], run): None for m, run in _held(*seen_lines(text), marks)}
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["k1", "k2", "run"])

    return marked.where(F.col(column).isNotNull()).select(text_col, column).mapInArrow(run, "k1 long, k2 long, run binary")


def without_chunks(text: bytes, marks: list[dict]) -> tuple[bytes, int, int]:
    """(text, chunks gone, words gone) less the marked pairs and long lines; blank lines inside a chunk go with it."""
    lines, which = seen_lines(text)
    go = [False] * len(lines)
    for m, _ in _held(lines, which, marks):
        i = m["at"]
        a, b = (which[~i], which[~i]) if i < 0 else (which[i], which[i + 1])
        go[a : b + 1] = [True] * (b + 1 - a)
    chunks = sum(b and not a for a, b in zip([False, *go], go, strict=False))
    return b"\n".join(x for x, out in zip(lines, go, strict=True) if not out), chunks, sum(len(x.split()) for x, out in zip(lines, go, strict=True) if out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_line: int | None = LONG_LINE) -> DataFrame:
    """``docs`` with the text less its repeated chunks, and n_chunks_removed, n_words_removed (long).

    Columns of those two names are replaced.
    """
    own = without(docs.columns, ["n_chunks_removed", "n_words_removed"])
    column = free_name(docs.columns, "_marks")
    key = ["k1", "k2"]
    one_text = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    found = cut(_pair_keys(one_text, id_col, text_col, long_line))
    repeats = cut(found.groupBy(key).agg(F.count("*").alias("total"), F.min(id_col).alias("first")).where("total > 1").select(*key, "first"))
    goes = (F.col(id_col) != F.col("first")) | F.col("again")
    marks = found.join(repeats, key).groupBy(id_col).agg(F.collect_list(F.struct(*key, "at", goes.alias("goes"))).alias(column))
    marked = cut(docs.select(own).join(marks, id_col, "left"))
    # Pairs of one hash whose bytes differ are no repeats.
    differing = cut(_marked_bytes(marked, text_col, column).distinct().groupBy(key).count().where("count > 1").select(key))
    if not differing.isEmpty():
        # Practically never: the marks of such keys go, by a join, so their number does not matter.
        kept = marks.select(id_col, F.explode(column).alias("m")).join(differing, (F.col("m.k1") == F.col("k1")) & (F.col("m.k2") == F.col("k2")), "left_anti").groupBy(id_col).agg(F.collect_list("m").alias(column))
        marked = docs.select(own).join(kept, id_col, "left")
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("n_chunks_removed", T.LongType()), T.StructField("n_words_removed", T.LongType())])
    leaving = F.filter(column, lambda m: m["goes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [without_chunks(text, marks) if text and marks else (text, 0, 0) for text, marks in zip(text_bytes(batch, text_col), batch.column(column).to_pylist(), strict=True)]
            texts, gone, words = zip(*out, strict=True) if out else ((), (), ())
            cols = {c: batch.column(c) for c in own} | {text_col: pa.array(texts, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(gone, pa.int64()), pa.array(words, pa.int64())], [*cols, "n_chunks_removed", "n_words_removed"])

    return marked.select(*own, leaving.alias(column)).mapInArrow(run, schema)
