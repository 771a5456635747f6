"""Hashed word and character n-gram features, and bounded labelled samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices, text_bytes

#: Distinct words whose summed weights a Python worker keeps; beyond it the memory starts anew.
CACHED_WORDS = 300_000
CACHED_WORD_BYTES = 64


def subwords(word: bytes, shortest: int, longest: int) -> list[int]:
    """Hashes of a word and of its character n-grams, with marks at both ends."""
    marked = b"<" + word + b">"
    n = len(marked)
    return [crc32(word), *(crc32(marked[i : i + k]) for k in range(shortest, min(longest, n) + 1) for i in range(n - k + 1))]


def pairs(words: list[bytes]) -> np.ndarray:
    """Hashes of neighbouring words."""
    h = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
    return (h[:-1] * np.uint32(0x9E3779B1)) ^ h[1:]


class WordWeights(dict):
    """Word -> sum of its features' weights, and i times their number; filled on demand."""

    def __init__(self, weights: np.ndarray, shortest: int, longest: int):
        super().__init__()
        self.weights, self.shortest, self.longest = weights.tolist(), shortest, longest

    def __missing__(self, word: bytes) -> complex:
        mask, weights = len(self.weights) - 1, self.weights
        found = subwords(word, self.shortest, self.longest)
        value = complex(sum(weights[h & mask] for h in found), len(found))
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def total(self, words: list[bytes]) -> complex:
        """Of all features of a text: the sum of weights, and i times their number."""
        return sum(map(self.__getitem__, words), 0j)


def counts(text: bytes, buckets: int, shortest: int, longest: int, with_pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share) of all features of a text; ``buckets`` is a power of two."""
    words = text.split()
    total = np.zeros(buckets)
    for word, n in Counter(words).items():
        np.add.at(total, np.array(subwords(word, shortest, longest), dtype=np.int64) & (buckets - 1), n)
    if with_pairs and len(words) > 1:
        total += np.bincount(pairs(words) & np.uint32(buckets - 1), minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at] / max(1.0, total.sum())


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_label: int, use: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Texts of about ``per_label`` documents of each label (at most twice as many), and all labels' counts.

    ``use`` chooses the ids that may be learned from.  The choice is by hash,
    so it does not depend on partitions.  Ids with several labels count with
    the smallest.
    """
    known = labels.where(use & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    n = dict(known.groupBy("_label").count().collect())
    share = F.when(F.col("_label") == 1, min(1.0, per_label / max(1, n.get(1, 0)))).otherwise(min(1.0, per_label / max(1, n.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share * (1 << 30)).limit(4 * per_label)
    # At most 4 * per_label ids are broadcast.
    texts = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col).select("_label", "_text")
    return texts, n


def sample_counts(texts: DataFrame, buckets: int, shortest: int, longest: int, with_pairs: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) of a bounded sample, in an order that depends on its content alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [counts(t or b"", buckets, shortest, longest, with_pairs) for t in text_bytes(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["label", "at", "share"])

    rows = texts.select("_label", "_text").mapInArrow(run, "label int, at binary, share binary").collect()
    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in rows)
    return [(y, np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for y, a, v in rows]
