"""Language identification by nearest centroid.

A text becomes a hashed vector of its character n-grams (letters lower-cased,
other characters a space), damped counts times inverse document frequency,
normalised to length one.  Each language has several centroids, found by
spherical k-means on a bounded sample of its labelled texts; a text gets the
language of the centroid with the greatest cosine.  A text whose best cosine
lies far under those of known texts of its size is rejected: it is no known
language.

Document frequencies are counted over all labelled texts.  Only the k-means
and the thresholds use a sample: about ``SAMPLE_PER_LANG`` texts of each
language (at most twice as many in all), chosen by a hash, so the choice does
not depend on partitions.

Null texts and texts without a letter are ``und`` with score 0, and rejected.
Without any labelled text every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import extend, slices, without

BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
CENTROIDS = 4
SAMPLE_PER_LANG = 500

#: Words of the snippets from which the cosines of short texts are learned.
SNIPPET_WORDS = (1, 2, 4, 8, 16, 32, 64)

#: A text is rejected under this share of the cosine that the poorest texts of its size reach.
REJECT_SHARE = 0.5
UNKNOWN = "und"

_OTHER = regex.compile(r"[^\p{L}]+")


def grams(text: str) -> np.ndarray:
    """Hashed n-gram numbers of a text, repeats included; empty without a letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    if not words:
        return np.empty(0, dtype=np.int64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    out = []
    for n in GRAMS:
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h & np.uint64(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


def vector(text: str | None, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text, of length one; without ``idf`` the buckets alone count."""
    found = grams(text) if text else np.empty(0, dtype=np.int64)
    if not len(found):
        return found, np.empty(0)
    counts = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    if idf is None:
        return at, np.empty(0)
    w = (1 + np.log(counts[at])) * idf[at]
    return at, w / max(float(np.sqrt((w * w).sum())), 1e-12)


def size_bin(n_grams):
    """Bin of a number of distinct n-grams; short texts have smaller cosines."""
    return np.minimum(31, np.floor(2 * np.log2(np.maximum(1, n_grams)))).astype(int)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # bucket x centroid, columns of length one
    least: np.ndarray  # cosine under which a text is rejected, by size_bin

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        at, w = vector(text, self.idf)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0, True
        cosines = w @ self.centroids[at]
        k = int(cosines.argmax())
        return self.langs[k], float(min(1.0, max(0.0, cosines[k]))), bool(cosines[k] < self.least[size_bin(len(at))])


def _kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, seeded in proportion to distance; returns centroids of length one."""
    rng = np.random.default_rng(0)
    centers = rows[[int(rng.integers(len(rows)))]]
    while len(centers) < min(k, len(rows)):
        far = np.maximum(0.0, 1.0 - (rows @ centers.T).max(axis=1)).astype(np.float64)
        if far.sum() <= 1e-9:
            break
        centers = np.vstack([centers, rows[rng.choice(len(rows), p=far / far.sum())]])
    for _ in range(rounds):
        own = (rows @ centers.T).argmax(axis=1)
        sums = np.array([rows[own == c].sum(axis=0) for c in range(len(centers))])
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(size > 0, sums / np.maximum(size, 1e-12), centers)
    return centers


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """(texts, documents by bucket) over all texts; each task sends one row of fixed width a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                at, _ = vector(text, None)
                df[at] += 1
                n += bool(len(at))
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], ["bucket", "n"])

    total = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS, dtype=np.int64)
    n = 0
    for bucket, count in total:
        if bucket < 0:
            n = count
        else:
            df[bucket] = count
    return n, df


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> Model:
    """Learn from rows with a non-null language; ids only choose the sample."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n, df = document_frequencies(rows, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    counts = dict(rows.groupBy(lang_col).agg(F.count("*").alias("n")).collect())  # languages: few by nature
    parts = _sample(rows, id_col, text_col, lang_col, counts, per_lang, idf)
    langs, centers, sizes, cosines = [], [], [], []
    for name in sorted(parts):
        whole = [v for v, _ in parts[name]]
        matrix = np.zeros((len(whole), BUCKETS), dtype=np.float32)
        for i, (at, w) in enumerate(whole):
            matrix[i, at] = w
        own = _kmeans(matrix, centroids)
        langs += [name] * len(own)
        centers.append(own)
        for _, snippets in parts[name]:
            for at, w in snippets:
                sizes.append(len(at))
                cosines.append(float((w @ own.T[at]).max()))
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(1))
    bins, cosines = size_bin(np.array(sizes)), np.array(cosines)
    # Bins with few texts lie between those around them; outside the filled ones the nearest counts.
    filled = [b for b in range(32) if (bins == b).sum() >= 20]
    least = np.zeros(32)
    if filled:
        least = np.interp(np.arange(32), filled, [REJECT_SHARE * np.quantile(cosines[bins == b], 0.01) for b in filled])
    return Model(langs, idf, np.vstack(centers).T.copy(), least)


def _sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str, counts: dict, per_lang: int, idf: np.ndarray) -> dict:
    """By language: (vector, vectors of snippets) of about ``per_lang`` texts, chosen by hash."""
    share = F.coalesce(*(F.when(F.col(lang_col) == k, F.lit(min(1.0, per_lang / n))) for k, n in counts.items())) if counts else F.lit(0.0)
    chosen = rows.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < share * (1 << 30))

    def pack(pairs: list) -> bytes:
        return b"".join(np.uint32(len(a)).tobytes() + a.astype(np.uint16).tobytes() + w.astype(np.float32).tobytes() for a, w in pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = []
            for text in batch.column(1).to_pylist():
                words = text.split()
                pairs = [vector(text, idf), *(vector(" ".join(words[len(words) // 2 :][:n]), idf) for n in SNIPPET_WORDS)]
                packed.append(pack(pairs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["lang", "packed"])

    out: dict = {}
    for lang, packed in chosen.select(F.col(lang_col).alias("lang"), text_col).mapInArrow(run, "lang string, packed binary").limit(2 * per_lang * max(1, len(counts))).collect():
        pairs, at = [], 0
        while at < len(packed):
            n = int(np.frombuffer(packed, np.uint32, 1, at)[0])
            pairs.append((np.frombuffer(packed, np.uint16, n, at + 4), np.frombuffer(packed, np.float32, n, at + 4 + 2 * n)))
            at += 4 + 6 * n
        if len(pairs[0][0]):
            out.setdefault(lang, []).append((pairs[0], [p for p in pairs if len(p[0])]))
    return {k: sorted(v, key=lambda p: (p[0][0].tobytes(), p[0][1].tobytes())) for k, v in out.items()}


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and lang_pred, score (cosine), rejected, which replace columns of their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x centroids
    new = ["lang_pred", "score", "rejected"]
    kept = without(keep, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            lang, score, out = zip(*map(model.predict, batch.column(text_col).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*kept, *new])

    schema = extend(docs.select(*kept).schema, "lang_pred string, score double, rejected boolean")
    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that the model rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([not model.predict(t)[2] for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
