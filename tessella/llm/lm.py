"""Language-model scores from a hierarchical Pitman-Yor model over words.

Tokens are the lower-cased words of a text and one end.  Every word, and the
start of a text, is a context with a restaurant of its own; all of them share
the unigram restaurant as their parent, whose base is uniform over the training
tokens and one unknown.  Each (context, token) count is that many customers;
every table of a context is a customer of the parent.

Seatings are sampled by Gibbs.  A step reseats all customers of a dish in a
restaurant at once: which of them sit together enters neither the predictive
probabilities nor the other dishes, only the number of tables does, and that is
drawn from its exact conditional given everything else, in proportion to
S(c, t) x P^t x prod(strength + discount x (tables + i)), with the generalised
Stirling number S counting the seatings of c customers at t tables and P the
parent's probability (for counts over ``EXACT`` S comes from its saddle point).
A sweep does so for all dishes of all contexts, side by side with the tables of
the other dishes as of the sweep before, then for all words of the parent.
Seatings go on from sweep to sweep; those after ``BURN_IN`` sweeps, ``SPACING``
apart, are the samples, and a text's probabilities are averaged over them.

How Spark holds this: texts become blocks; a block sends its (context, token,
text) triples to the bucket of each context, where counts, seatings and
probabilities of a context are at home, and gets back sums by text.  Contexts
that are frequent are split over several buckets by their next token (which
ones is decided on a sample of texts; results do not depend on it), with their
totals added up after each sweep.  Words of the parent live in parts by the
range of their hash; buckets and parts exchange table counts and probabilities
of the words that a bucket has.  Only totals, and those of split contexts, go
through the driver.  Blocks, buckets and parts have a bounded size, and their
number follows the corpus.  Random numbers depend on context, token and sweep
alone, so a lost task draws the same seating again.

Words are known by their 64-bit hash.  Null and empty texts are the end alone.
Tokens never seen in training have the unknown's probability.  Without training
texts everything is unknown.  Repeated rows of one id are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import cut, cut_by, free_name, slices, text_bytes, without

#: Tokens of a block, and of a bucket: about; the largest units that a task holds.
BLOCK_TOKENS = 1_500_000
BUCKET_TOKENS = 2_500_000

#: Texts, about, on which it is decided which contexts are split over buckets.
LAYOUT_TEXTS = 20_000

STRENGTH = 1.0
BURN_IN = 1  # sweeps before the first sample
SAMPLES = 2
SPACING = 1  # sweeps from one sample to the next

#: Customers of a dish up to which the Stirling numbers are exact.
EXACT = 200

END = b"\n"
START_ID = 0x9E3779B97F4A7C15  # the context that starts a text

_ROW = "_kind int, _bucket int, _part int, _block long, _at int, _data binary"
_TEXT, _ASK, _MODEL, _SEATS, _WORDS, _TABLES, _TOTAL, _PARENT, _SUMS = range(9)


# -- packed arrays -----------------------------------------------------------------------------

_CODEC = "zstd"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: ascending ones by their steps, whole numbers in the fewest bytes that hold them, lowest bytes of all first."""
    parts = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        steps = 0
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and len(a):
            first, last = int(a[0]), int(a[-1])
            if 0 <= first <= last and bool((a[1:] >= a[:-1]).all()):
                steps = 2 if a.dtype == np.uint64 else 1
                a = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
            a = a.astype(np.min_scalar_type(int(a.max())) if int(a.min()) >= 0 else np.int64)
        a = np.ascontiguousarray(a)
        raw = (a.view(np.uint8).reshape(len(a), a.itemsize).T if a.itemsize > 1 else a).tobytes()
        small = pa.compress(raw, codec=_CODEC, asbytes=True) if raw else b""
        parts += [a.dtype.str.encode().ljust(4), bytes([steps]), len(raw).to_bytes(8, "little"), len(small).to_bytes(8, "little"), small]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(int.from_bytes(data[:4], "little")):
        dtype, steps, size, small = np.dtype(data[at : at + 4].decode().strip()), data[at + 4], int.from_bytes(data[at + 5 : at + 13], "little"), int.from_bytes(data[at + 13 : at + 21], "little")
        at += 21
        raw = np.frombuffer(pa.decompress(data[at : at + small], decompressed_size=size, codec=_CODEC, asbytes=True) if size else b"", np.uint8)
        a = np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel() if size else np.zeros(0, dtype)
        out.append(np.cumsum(a, dtype=np.uint64).astype((None, np.int64, np.uint64)[steps]) if steps else a)
        at += small
    return out


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    """A table of (kind, bucket, part, block, at, data) rows; other columns are null."""
    given = zip(*rows, strict=True) if rows else [[]] * 6
    cols = dict(zip([f.strip().split()[0] for f in _ROW.split(",")], given, strict=True))
    return pa.table([pa.array(list(cols[f.name]), f.type) if f.name in cols else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


_PLAIN = pa.schema([("_kind", pa.int32()), ("_bucket", pa.int32()), ("_part", pa.int32()), ("_block", pa.int64()), ("_at", pa.int32()), ("_data", pa.binary())])


def _data(table: pa.Table, kind: int, *names: str) -> list[tuple]:
    """(values of names, unpacked data) of the rows of a kind, in the order of the names."""
    chosen = table.filter(pc.equal(table.column("_kind"), kind))
    cols = [chosen.column(n).to_pylist() for n in names]
    order = sorted(range(chosen.num_rows), key=lambda i: [c[i] for c in cols])
    data = chosen.column("_data")
    return [(*(c[i] for c in cols), unpack(data[i].as_py())) for i in order]


# -- seatings ----------------------------------------------------------------------------------


def _mix(*keys: np.ndarray | int) -> np.ndarray:
    """Uniform numbers that depend on the keys alone."""
    x = np.uint64(0x243F6A8885A308D3)
    for k in keys:
        x = np.asarray(x ^ np.asarray(k).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)





def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for positive numbers: Stirling's series after a shift."""
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def stirling(most: int, discount: float) -> np.ndarray:
    """[c, t]: log of the generalised Stirling numbers, by S(c + 1, t) = S(c, t - 1) + (c - discount t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0.0))
        stay[t > c] = -np.inf
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) from c!/(t! d^t) [z^c] (1 - (1-z)^d)^t at its saddle point; for t over c^d."""
    low, high = np.full(c.shape, -16.0), np.full(c.shape, 6.5)  # log y, with z = 1 - exp(-y)
    share = lambda y: -np.expm1(-y) * d * np.exp((1 - d) * y) / -np.expm1(-d * y)  # noqa: E731  grows from 1
    for _ in range(32):
        mid = 0.5 * (low + high)
        big = share(np.exp(mid)) > c / t
        high, low = np.where(big, mid, high), np.where(big, low, mid)
    y = np.exp(0.5 * (low + high))
    z = -np.expm1(-y)
    h = 1e-4 * y
    slope = (share(y + h) - share(y - h)) / (2 * h) * np.exp(y) * z  # in log z
    out = _lgamma(c + 1) - _lgamma(t + 1) - t * math.log(d) + t * np.log(-np.expm1(-d * y)) - c * np.log(z) - 0.5 * np.log(2 * math.pi * np.maximum(t * slope, 1e-12))
    return np.where(t == c, 0.0, out)


def stirling_large(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) of counts over EXACT: ``c`` one a row, ``t`` numbers of tables by row.

    For t up to c^d by the sum over j of (-1)^j C(t, j) Gamma(c - jd) / Gamma(-jd),
    over t! d^t, whose terms fall fast there; beyond, from the saddle point.
    """
    d = discount
    ratio = np.empty((len(c), 40))  # of each term's Gamma quotient to the one before
    first = math.lgamma(1 + d) + _lgamma(c - d)
    before, sign = first, math.sin(math.pi * d)
    total, term = np.ones_like(t), np.ones_like(t)
    for j in range(2, 41):
        x = j * d
        now = math.lgamma(1 + x) + _lgamma(c - x)
        s = math.sin(math.pi * x)
        ratio = -np.exp(now - before) * (s / sign if abs(sign) > 1e-12 else 0.0)
        if abs(s) <= 1e-12:  # a pole of Gamma: the term is nothing, the next goes on from the one before it
            term_at = term * 0
        else:
            term_at = None
        scale = np.maximum(t - j + 1, 0) / j
        if term_at is None:
            term = term * scale * ratio[:, None]
            total = total + term
            before, sign = now, s
        else:
            term = -term * scale
    with np.errstate(all="ignore"):
        out = np.log(t) + first[:, None] + math.log(math.sin(math.pi * d) / math.pi) + np.log(np.maximum(total, 1e-300)) - t * math.log(d) - _lgamma(t + 1)
    wide = np.broadcast_to(c[:, None], t.shape)
    beyond = t > wide**d
    if beyond.any():
        out[beyond] = _saddle(wide[beyond], t[beyond], d)
    return out


class Draw:
    """Draws numbers of tables from their exact conditionals."""

    def __init__(self, discount: float):
        self.discount = discount
        self.exact: np.ndarray | None = None

    def __call__(self, c: np.ndarray, p: np.ndarray, others: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """Tables of dishes with ``c`` customers: ``p`` the parent's probability, ``others`` the restaurant's tables less the dish's own."""
        tables = np.minimum(c, 1).astype(np.int64)
        weight = STRENGTH + self.discount * np.maximum(others, 0.0)
        small = np.flatnonzero((c > 1) & (c <= EXACT))
        if len(small) and self.exact is None:
            self.exact = stirling(EXACT, self.discount)
        order = small[np.argsort(c[small], kind="stable")]
        for start in range(0, len(order), 8192):
            rows = order[start : start + 8192]
            most = int(c[rows[-1]])
            for a, b in self._alike(c[rows]):
                part, n = rows[a:b], int(c[rows[b - 1]])
                t = np.arange(1, n + 1)
                logs = self.exact[c[part], 1 : n + 1] + t * np.log(p[part])[:, None]
                logs[:, 1:] += np.cumsum(np.log(weight[part][:, None] + self.discount * t[None, :-1]), axis=1)
                tables[part] = 1 + self._choose(logs, uniform[part])
            del most
        large = np.flatnonzero(c > EXACT)
        for start in range(0, len(large), 2048):
            rows = large[start : start + 2048]
            tables[rows] = self._large(c[rows].astype(float), np.log(p[rows]), weight[rows], uniform[rows])
        return tables

    @staticmethod
    def _alike(c: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of ascending counts within a factor of 1.5."""
        a = 0
        while a < len(c):
            b = int(np.searchsorted(c, max(int(c[a]), int(1.5 * c[a])), side="right"))
            yield a, b
            a = b

    @staticmethod
    def _choose(logs: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        w = np.exp(logs - logs.max(axis=1, keepdims=True)).cumsum(axis=1)
        return (w < (uniform * w[:, -1])[:, None]).sum(axis=1)

    def _log_weight(self, c: np.ndarray, t: np.ndarray, log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        a = (weight / self.discount)[:, None]
        return stirling_large(c, t, self.discount) + t * (log_p[:, None] + math.log(self.discount)) + _lgamma(a + t) - _lgamma(a)

    def _large(self, c: np.ndarray, log_p: np.ndarray, weight: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """The peak is sought on ever finer grids; then all table numbers around it, in steps if they are many, are weighed."""
        rows = np.arange(len(c))
        low, high = np.ones(len(c)), c.copy()
        while True:  # log weights have one peak
            grid = np.floor(low[:, None] * (high / low)[:, None] ** np.linspace(0, 1, 24)[None, :])
            k = self._log_weight(c, grid, log_p, weight).argmax(axis=1)
            low, peak, high = grid[rows, np.maximum(k - 1, 0)], grid[rows, k], grid[rows, np.minimum(k + 1, 23)]
            if (high - low <= np.maximum(24, 0.5 * np.sqrt(peak))).all():
                break
        step = np.ceil(np.maximum(1.0, 8 * np.sqrt(peak) / 48))
        grid = peak[:, None] + step[:, None] * (np.arange(97) - 48)[None, :]
        safe = np.clip(grid, 1, c[:, None])
        logs = np.where(grid == safe, self._log_weight(c, safe, log_p, weight), -np.inf)
        t = safe[rows, np.minimum(self._choose(logs, uniform), 96)]
        within = np.floor(((uniform * 7919) % 1.0) * step) - np.floor(step / 2)
        return np.clip(t + within, 1, c).astype(np.int64)


# -- what all tasks know -----------------------------------------------------------------------


@dataclass
class Shape:
    """Number of buckets and parts, and the contexts that are split: by id, over how many buckets."""

    buckets: int
    parts: int
    split: dict[int, int] = field(default_factory=dict)

    def bucket(self, ids: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The bucket of (context, token) pairs, given by their places in ``ids``."""
        home = ((ids >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int32)
        out = home[u]
        over = np.ones(len(ids), dtype=np.int32)
        for context in np.flatnonzero(np.isin(ids, np.array(list(self.split), dtype=np.uint64))).tolist():
            over[context] = self.split[int(ids[context])]
        at = np.flatnonzero(over[u] > 1)
        spread = (ids >> np.uint64(8)).astype(np.uint32)
        out[at] = (out[at] + spread[w[at]] % over[u[at]]) % self.buckets
        return out

    def bounds(self) -> np.ndarray:
        """First id of every part but the first."""
        return np.array([(k << 64) // self.parts for k in range(1, self.parts)], dtype=np.uint64)


@dataclass
class Totals:
    n: int = 0  # training tokens
    vocabulary: int = 0  # different ones
    discount: float = 0.5
    root_discount: float = 0.5
    customers: int = 0  # of the parent
    tables: int = 0
    #: Of split contexts, by id: customers, tables.
    split: dict[int, tuple[int, int]] = field(default_factory=dict)

    def parent(self, seated: np.ndarray) -> np.ndarray:
        """Probabilities from customers less discounted tables of words in the parent."""
        return (seated + (STRENGTH + self.root_discount * self.tables) / (self.vocabulary + 1)) / (STRENGTH + self.customers)


def _discount(once: int, twice: int) -> float:
    """The usual estimate from the numbers of dishes seen once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def _word_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class _Numbers(dict):
    """word -> its number in a block."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


# -- texts to buckets --------------------------------------------------------------------------


def _shape(docs: DataFrame, text_col: str, block_tokens: int, bucket_tokens: int) -> Shape:
    """Sizes from the length of all texts; split contexts from a sample of texts."""
    chars, n = docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)), F.count("*")).first()
    tokens = chars / 6 + n
    buckets = max(1, math.ceil(tokens / bucket_tokens))
    if buckets == 1:
        return Shape(1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        for batch in slices(batches):
            for text in text_bytes(batch, text_col):
                for w in text.lower().split() if text else ():
                    words[w] = words.get(w, 0) + 1
                words[END] = words.get(END, 0) + 1
        total = max(1, sum(words.values()))
        held = [(w, c) for w, c in words.items() if c * 16 * buckets >= total] + [(None, total)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.binary()), pa.array([c for _, c in held], pa.int64())], ["word", "n"])

    share = min(1.0, LAYOUT_TEXTS / n)
    sample = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < share * (1 << 30))
    found = sample.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = found.where("word IS NULL").first()
    if total is None:
        return Shape(buckets, buckets)
    # Shares of over a quarter of a bucket: at most four times as many contexts as buckets.
    often = found.where((F.col("word").isNotNull()) & (F.col("n") * 4 * buckets >= total.n)).collect()
    split = {(START_ID if bytes(w) == END else _word_id(bytes(w))): min(buckets, math.ceil(4 * buckets * c / total.n)) for w, c in often}
    return Shape(buckets, buckets, split)


def _block_rows(numbers: _Numbers, starts: list[int], own: np.ndarray, learn: np.ndarray, block: int, shape: Shape, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The messages of a block to all buckets that its contexts live in."""
    ids = np.fromiter(map(_word_id, numbers), dtype=np.uint64, count=len(numbers))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int32)
    rank[order] = np.arange(len(ids), dtype=np.int32)
    first = np.array(starts, dtype=np.int64)
    text = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(own)]))
    w = rank[own]
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[first] = len(ids)  # the start, whose id is put after all others
    by_rank = np.r_[ids[order], np.uint64(START_ID)]
    bucket = shape.bucket(by_rank, u, w)
    key = u.astype(np.int64)
    key <<= 32
    key |= w
    at = np.argsort(key, kind="stable")
    del key
    at = at[np.argsort(bucket[at], kind="stable")]
    u, w, text, bucket = u[at], w[at], text[at], bucket[at]
    del at
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(u)], strict=True):
        runs = np.flatnonzero(np.r_[True, u[a + 1 : b] != u[a : b - 1]])
        words, at = np.unique(w[a:b], return_inverse=True)
        data = pack(by_rank[u[a:b][runs]], np.diff(np.r_[runs, b - a]), by_rank[words], at, text[a:b], np.packbits(learn))
        yield from _rows([(_ASK, int(bucket[a]), -1, block, len(first), data)], schema).to_batches()


def _messages(docs: DataFrame, keep: list[str], text_col: str, learn_col: str, shape: Shape, block_tokens: int, schema: T.StructType) -> DataFrame:
    """A row for every text, and the messages of blocks to buckets."""
    n_tokens = schema.fields[len(keep)].name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = TaskContext.get().partitionId(), 0
        numbers, starts, parts, learned, n = _Numbers(), [], [], [], 0
        arrow: pa.Schema | None = None
        block = (part << 24) | blocks
        for batch in slices(batches):
            if arrow is None:
                arrow = pa.schema([*(pa.field(c, batch.schema.field(c).type) for c in keep), pa.field(n_tokens, pa.int64()), *_PLAIN])
            texts, at = [], []
            flags = batch.column(learn_col).to_pylist()
            for i, text in enumerate(text_bytes(batch, text_col)):
                if n >= block_tokens:
                    # The texts so far go with their block.
                    yield pa.RecordBatch.from_arrays(_text_columns(batch, keep, len(at) and i - len(at), texts, at, block, shape), schema=arrow)
                    yield from _block_rows(numbers, starts, np.concatenate(parts), np.array(learned), block, shape, arrow)
                    blocks += 1
                    block = (part << 24) | blocks
                    numbers, starts, parts, learned, n = _Numbers(), [], [], [], 0
                    texts, at = [], []
                words = text.lower().split() if text else []
                words.append(END)
                starts.append(n)
                at.append(len(starts) - 1)
                texts.append(len(words))
                learned.append(bool(flags[i]))
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                n += len(words)
            yield pa.RecordBatch.from_arrays(_text_columns(batch, keep, batch.num_rows - len(at), texts, at, block, shape), schema=arrow)
        if starts:
            yield from _block_rows(numbers, starts, np.concatenate(parts), np.array(learned), block, shape, arrow)

    return docs.select(*keep, text_col, learn_col).mapInArrow(run, schema)


def _text_columns(batch: pa.RecordBatch, keep: list[str], first: int, lengths: list[int], at: list[int], block: int, shape: Shape) -> list[pa.Array]:
    k = len(at)
    return [*(batch.column(c).slice(first, k) for c in keep), pa.array(lengths, pa.int64()), pa.array([_TEXT] * k, pa.int32()), pa.array([(block ^ (block >> 24)) % shape.buckets] * k, pa.int32()), pa.nulls(k, pa.int32()), pa.array([block] * k, pa.int64()), pa.array(at, pa.int32()), pa.nulls(k, pa.binary())]


# -- buckets -----------------------------------------------------------------------------------


def _by_part(words: np.ndarray, shape: Shape) -> list[tuple[int, int, int]]:
    """(part, first, end) of ascending ids."""
    ends = np.r_[0, np.searchsorted(words, shape.bounds()), len(words)]
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]


def _context_sums(runs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over the pairs of each context."""
    return np.add.reduceat(values, np.cumsum(runs) - runs) if len(runs) else np.zeros(0, values.dtype)


def _merge(table: pa.Table, shape: Shape) -> pa.Table:
    """The messages to a bucket: its counts, which of its pairs each text asks for, and what its words' parts must know."""
    schema = table.schema
    texts = table.filter(pc.equal(table.column("_kind"), _TEXT))
    asks = _data(table, _ASK, "_block", "_at")
    if not asks:
        return texts
    bucket = table.column("_bucket")[0].as_py()
    contexts = np.unique(np.concatenate([d[0] for *_, d in asks]))
    words = np.unique(np.concatenate([d[2] for *_, d in asks]))
    keys, learned = [], []
    for _, n_texts, (u, runs, w, at, text, learn) in asks:
        keys.append((np.repeat(np.searchsorted(contexts, u), runs) << 32) | np.searchsorted(words, w)[at])
        learned.append(np.unpackbits(learn, count=n_texts)[text])
    key = np.concatenate(keys)
    del keys
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    pairs = key[new]
    number = np.empty(len(key), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    del key, order, new
    c = np.bincount(number, weights=np.concatenate(learned), minlength=len(pairs)).astype(np.int64)
    u, w = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
    del pairs
    runs = np.bincount(u, minlength=len(contexts))
    rows = [(_MODEL, bucket, -1, None, None, pack(contexts, runs, words, w, c))]
    start = 0
    for block, n_texts, (*_, text, _) in asks:
        own = number[start : start + len(text)]
        start += len(text)
        rows.append((_ASK, bucket, -1, block, n_texts, pack(np.diff(own, prepend=np.int32(0)), text)))
    # Pairs of two customers and more have seatings to sample; the others sit alone.
    several = np.flatnonzero(c > 1)
    own_words, at = np.unique(w[several], return_inverse=True)
    own_contexts, runs_s = np.unique(u[several], return_counts=True)
    total, alone = _context_sums(runs, c), _context_sums(runs, (c == 1).astype(np.int64))
    tables = np.ones(len(several), np.int64)
    rows.append((_SEATS, bucket, -1, None, None, pack(contexts[own_contexts], runs_s, words[own_words], at, c[several], tables, np.zeros(len(several), np.int64), alone[own_contexts])))
    rows += _table_messages(bucket, words[own_words], np.bincount(at, weights=tables, minlength=len(own_words)), shape)
    single = np.bincount(w, weights=c == 1, minlength=len(words)).astype(np.int64)
    rows += [(_WORDS, bucket, k, None, None, pack(words[a:b], single[a:b])) for k, a, b in _by_part(words, shape)]
    hot = _split_places(contexts, shape)
    rows.append((_TOTAL, bucket, -1, None, None, pack(np.array([c.sum(), (c == 1).sum(), (c == 2).sum()]), contexts[hot], total[hot], alone[hot] + _context_sums(runs, (c > 1).astype(np.int64))[hot])))
    return pa.concat_tables([texts, _rows(rows, schema)])


def _split_places(contexts: np.ndarray, shape: Shape) -> np.ndarray:
    return np.flatnonzero(np.isin(contexts, np.array(list(shape.split), dtype=np.uint64)))


def _table_messages(bucket: int, words: np.ndarray, tables: np.ndarray, shape: Shape) -> list[tuple]:
    return [(_TABLES, bucket, k, None, None, pack(words[a:b], tables[a:b].astype(np.int64))) for k, a, b in _by_part(words, shape)]


def _lookup(ids: np.ndarray, known: dict[int, tuple[int, int]], which: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids that are known to the split contexts, and their value."""
    keys = np.array(sorted(known), dtype=np.uint64)
    at = np.flatnonzero(np.isin(ids, keys))
    return at, np.array([known[int(x)][which] for x in ids[at]], dtype=np.int64)


def _reseat(seats: pa.Table, answers: pa.Table, totals: Totals, shape: Shape, sweep: int, sampled: bool) -> pa.Table:
    """A sweep over the dishes of a bucket."""
    found = _data(seats, _SEATS)
    if not found:
        return _rows([], _PLAIN)
    bucket = seats.column("_bucket")[0].as_py()
    contexts, runs, words, at, c, tables, summed, alone, *samples = found[0][-1]
    seated = np.concatenate([d[0] for *_, d in _data(answers, _PARENT, "_part")] or [np.zeros(0)])
    c, tables = c.astype(np.int64), tables.astype(np.int64)
    u = np.repeat(np.arange(len(contexts)), runs)
    all_tables = alone.astype(np.int64) + _context_sums(runs.astype(np.int64), tables)
    places, values = _lookup(contexts, totals.split, 1)
    all_tables[places] = values
    parent = totals.parent(seated)
    drawn = Draw(totals.discount)(c, parent[at], all_tables[u] - tables, _mix(contexts[u], words[at], sweep))
    rows = _table_messages(bucket, words, np.bincount(at, weights=drawn, minlength=len(words)), shape)
    own = alone.astype(np.int64) + _context_sums(runs.astype(np.int64), drawn)
    if sampled:
        summed, samples = summed.astype(np.int64) + drawn, [*samples, own]
    rows.append((_SEATS, bucket, -1, None, None, pack(contexts, runs, words, at, c, drawn, summed, alone, *samples)))
    hot = _split_places(contexts, shape)
    moved = own[hot] - alone.astype(np.int64)[hot] - _context_sums(runs.astype(np.int64), tables)[hot]
    rows.append((_TOTAL, bucket, -1, None, None, pack(np.zeros(3, np.int64), contexts[hot], np.zeros(len(hot), np.int64), moved)))
    return _rows(rows, _PLAIN)


# -- the parent --------------------------------------------------------------------------------


def _seat_words(state: pa.Table, messages: pa.Table, totals: Totals, sweep: int, sampled: bool) -> pa.Table:
    """A sweep over the words of a part: adds up the tables of all contexts, draws its own, and answers the buckets."""
    told = _data(messages, _TABLES, "_bucket")
    part = (state if state.num_rows else messages).column("_part")[0].as_py()
    held = _data(state, _MODEL)
    if held:
        words, single, tables, *samples = held[0][-1]
    else:  # the first time: what buckets say of all their words
        said = _data(state, _WORDS)
        words, at = np.unique(np.concatenate([d[0] for *_, d in said] or [np.zeros(0, np.uint64)]), return_inverse=True)
        single = np.bincount(at, weights=np.concatenate([d[1] for *_, d in said] or [np.zeros(0)]), minlength=len(words)).astype(np.int64)
        tables, samples = np.zeros(len(words), np.int64), []
    n = single.astype(np.int64)
    places = [np.searchsorted(words, d[0]) for *_, d in told]
    for k, (*_, d) in zip(places, told, strict=True):
        n[k] += d[1].astype(np.int64)
    base = np.full(len(words), 1 / (totals.vocabulary + 1)) if totals.vocabulary else np.full(len(words), 1.0)
    if sweep:
        drawn = Draw(totals.root_discount)(n, base, totals.tables - tables.astype(np.int64), _mix(words, 0, sweep))
    else:
        drawn = np.minimum(n, 1)
    seated = n - totals.root_discount * drawn
    if sampled:
        samples = [*samples, n, drawn]
    rows = [(_MODEL, -1, part, None, None, pack(words, single, drawn, *samples))]
    rows += [(_PARENT, b, part, None, None, pack(np.stack([n[k], drawn[k]]).ravel() if not sweep else seated[k])) for (b, _), k in zip(told, places, strict=True)]
    rows.append((_TOTAL, -1, part, None, None, pack(np.array([n.sum(), drawn.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum()]))))
    return _rows(rows, _PLAIN)


def _answer_words(state: pa.Table, asked: pa.Table) -> pa.Table:
    """By bucket and part: for all its words, customers and tables of every sample."""
    held = _data(state, _MODEL)
    rows = []
    if held:
        words, _, _, *samples = held[0][-1]
        part = state.column("_part")[0].as_py()
        for b, (own, _) in _data(asked, _WORDS, "_bucket"):
            at = np.searchsorted(words, own)
            rows.append((_PARENT, b, part, None, None, pack(*(s[at] for s in samples))))
    return _rows(rows, _PLAIN)


# -- scores ------------------------------------------------------------------------------------


def pair_probabilities(model: list[np.ndarray], seats: list[np.ndarray] | None, parents: list[list[np.ndarray]], totals: list[Totals]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each pair of a bucket, its context by number, customers of all contexts), averaged over samples."""
    contexts, runs, words, w, c = model
    c = c.astype(np.int64)
    u = np.repeat(np.arange(len(contexts)), runs)
    customers = _context_sums(runs.astype(np.int64), c)
    alone = _context_sums(runs.astype(np.int64), (c == 1).astype(np.int64))
    places, values = _lookup(contexts, totals[0].split, 0)
    customers[places] = values
    several = np.flatnonzero(c > 1)
    tables = np.minimum(c, 1).astype(np.float64)
    if len(several):
        tables[several] = seats[6].astype(np.float64) / len(totals)
        in_seats = np.searchsorted(contexts, seats[0])
    p = np.maximum(0.0, c - totals[0].discount * tables) / (STRENGTH + customers[u])
    for s, known in enumerate(totals):
        all_tables = alone.copy()
        if len(several):
            all_tables[in_seats] = seats[8 + s].astype(np.int64)
        places, values = _lookup(contexts, known.split, 1)
        all_tables[places] = values
        seated = np.concatenate([x[2 * s].astype(np.float64) - known.root_discount * x[2 * s + 1].astype(np.float64) for x in parents])
        p += ((STRENGTH + known.discount * all_tables) / (STRENGTH + customers))[u] * known.parent(seated)[w] / len(totals)
    return p, u, customers


def _text_sums(held: pa.Table, found: pa.Table, totals: list[Totals]) -> pa.Table:
    """Sums by text of the logarithms of a bucket's probabilities; rows of texts are handed on."""
    texts = held.filter(pc.equal(held.column("_kind"), _TEXT))
    model = _data(held, _MODEL)
    if not model:
        return texts
    seats = _data(found, _SEATS)
    p, u, customers = pair_probabilities(model[0][-1], seats[0][-1] if seats else None, [d for *_, d in _data(found, _PARENT, "_part")], totals)
    log_p = np.log10(p)
    base = np.log10((customers + 0.5) / (totals[0].n + 0.5 * (totals[0].vocabulary + 1)))[u]
    known = (customers > 0)[u]
    rows = []
    for block, n_texts, (steps, text) in _data(held, _ASK, "_block", "_at"):
        own = np.cumsum(steps.astype(np.int64))
        asked, place = np.unique(text, return_inverse=True)
        sums = [np.bincount(place, weights=x[own], minlength=len(asked)) for x in (log_p, base, known)]
        rows.append((_SUMS, None, -1, block, n_texts, pack(asked, sums[0], sums[1], sums[2].astype(np.int64))))
    return pa.concat_tables([texts, _rows(rows, held.schema)])


def _score_block(table: pa.Table, keep: list[str], n_tokens: str, total: int) -> pa.Table:
    texts = table.filter(pc.equal(table.column("_kind"), _TEXT)).sort_by("_at")
    n = texts.num_rows
    sums = np.zeros((3, n))
    for asked, *values in (d for *_, d in _data(table, _SUMS)):
        for k in range(3):
            sums[k, asked] += values[k]
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    cols = [*(texts.column(c) for c in keep), texts.column(n_tokens), pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(sums[1]), pa.array(sums[0])]
    return pa.table(cols, names=[*keep, *names])


def _told(rows: DataFrame) -> list[list[np.ndarray]]:
    """What buckets or parts say of their totals: a row each, of a few numbers, and of split contexts."""
    return [unpack(bytes(r._data)) for r in rows.where(F.col("_kind") == _TOTAL).select("_data").toLocalIterator()]


def _add_contexts(told: list[list[np.ndarray]], totals: Totals, first: bool) -> None:
    """Take in the totals of buckets."""
    if first:
        counts = sum((d[0].astype(np.int64) for d in told), np.zeros(3, np.int64))
        totals.n, totals.discount = int(counts[0]), _discount(int(counts[1]), int(counts[2]))
    split = dict(totals.split)
    for _, ids, customers, tables in told:
        for i, c, t in zip(ids.tolist(), customers.tolist(), tables.tolist(), strict=True):
            have = split.get(i, (0, 0))
            split[i] = have[0] + c, have[1] + t
    totals.split = split


def _add_parent(told: list[list[np.ndarray]], totals: Totals, first: bool) -> None:
    """Take in the totals of parts."""
    got = sum((d[0].astype(np.int64) for d in told), np.zeros(5, np.int64))
    totals.customers, totals.tables = int(got[0]), int(got[1])
    if first:
        totals.vocabulary, totals.root_discount = int(got[2]), _discount(int(got[3]), int(got[4]))


def score(docs: DataFrame, learn: Column, keep: list[str], text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES, spacing: int = SPACING, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Score all texts by a model of those for which ``learn`` (a condition on ``docs``) holds.

    The columns ``keep`` of ``docs``, n_tokens, n_known, train_tokens,
    base_score and score (log10 of the text's probability), which replace
    columns of their names.
    """
    keep = without(keep, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    taken = [*keep, *_PLAIN.names]
    text, learned, n_tokens = (free_name([*taken, "_text", "_n"], x) for x in ("_text_", "_learn", "_n_tokens"))
    inner = [free_name(_PLAIN.names, f"_keep{i}") for i in range(len(keep))]
    spark = docs.sparkSession
    named = docs.select(*(F.col(c).alias(i) for c, i in zip(keep, inner, strict=True)), F.col(text_col).alias(text), F.coalesce(learn, F.lit(False)).alias(learned))
    shape = _shape(named, text, block_tokens, bucket_tokens)
    kept = [T.StructField(f.name, f.dataType) for f in named.select(*inner).schema.fields]  # null in messages
    wide = T.StructType([*kept, T.StructField(n_tokens, T.LongType()), *T.StructType.fromDDL(_ROW).fields])
    kind = F.col("_kind")
    held = cut_by(_messages(named, inner, text, learned, shape, block_tokens, wide).groupBy("_bucket").applyInArrow(lambda t: _merge(t, shape), wide), "_bucket", shape.buckets)
    plain = held.select(*_PLAIN.names)
    totals = Totals()
    _add_contexts(_told(plain), totals, first=True)

    def seat_contexts(seats: DataFrame, answers: DataFrame, sweep: int, sampled: bool) -> DataFrame:
        now = replace(totals)
        rows = cut(seats.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(lambda a, b: _reseat(a, _as_seated(b, now, sweep), now, shape, sweep, sampled), _ROW))
        _add_contexts(_told(rows), totals, first=False)
        return rows

    def seat_parent(state: DataFrame, told: DataFrame, sweep: int, sampled: bool) -> DataFrame:
        now = replace(totals)
        rows = cut(state.groupBy("_part").cogroup(told.where(kind == _TABLES).groupBy("_part")).applyInArrow(lambda a, b: _seat_words(a, b, now, sweep, sampled), _ROW))
        _add_parent(_told(rows), totals, first=not sweep)
        return rows

    parent = seat_parent(plain.where(kind == _WORDS), plain, 0, False)
    seats, answers, sampled_totals = plain.where(kind == _SEATS), parent.where(kind == _PARENT), []
    for sweep in range(1, burn_in + 1 + (samples - 1) * spacing + 1):
        sampled = sweep > burn_in and (sweep - burn_in - 1) % spacing == 0
        moved = seat_contexts(seats, answers, sweep, sampled)
        parent = seat_parent(parent.where(kind == _MODEL), moved, sweep, sampled)
        seats, answers = moved.where(kind == _SEATS), parent.where(kind == _PARENT)
        if sampled:
            sampled_totals.append(replace(totals))
    asked = plain.where(kind == _WORDS)
    words = parent.where(kind == _MODEL).groupBy("_part").cogroup(asked.groupBy("_part")).applyInArrow(_answer_words, _ROW)
    found = seats.unionByName(words)
    mine = held.where(kind.isin(_TEXT, _MODEL, _ASK))
    sums = mine.groupBy("_bucket").cogroup(found.groupBy("_bucket")).applyInArrow(lambda a, b: _text_sums(a, b, sampled_totals), wide)
    schema = T.StructType([*kept, *T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    total = totals.n
    out = sums.groupBy("_block").applyInArrow(lambda t: _score_block(t, inner, n_tokens, total), schema)
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)), *(f.name for f in schema.fields[len(inner) :]))


def _as_seated(answers: pa.Table, totals: Totals, sweep: int) -> pa.Table:
    """The first answers carry customers and tables, as the discount is not known before them."""
    if sweep > 1:
        return answers
    rows = []
    for part, d in _data(answers, _PARENT, "_part"):
        n, tables = d[0].astype(np.int64).reshape(2, -1)
        rows.append((_PARENT, -1, part, None, None, pack(n - totals.root_discount * tables)))
    return _rows(rows, _PLAIN)


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: the perplexity per token of all scored texts, and that of the base."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.agg(per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))
