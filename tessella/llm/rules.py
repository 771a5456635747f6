"""Quality rules: fixed base rules and a calibrated n-gram logistic regression.

Base rules, over words (runs of anything but ASCII white space): a text fails
with under ``MIN_WORDS`` words, or if over half of them stand in a 3-word
window that the text holds twice or more.

The method's verdict is a logistic regression over hashed words, neighbouring
words and character n-grams (their shares of all features of the text), trained
on a bounded sample of labelled rows: about ``SAMPLE_PER_LABEL`` of each label,
chosen by a hash of the id.  A quarter of the sample is kept back
and calibrates the output to probabilities (Platt's two-parameter fit), which
meet a fixed threshold.  Scoring runs in Arrow batches.

Null and empty texts have no words: every count is zero and the base fails.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tessella.llm import subwords
from tessella.llm.common import extend, slices, text_bytes, without

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

BUCKETS = 1 << 17
SHORTEST, LONGEST = 2, 4
SAMPLE_PER_LABEL = 1000
EPOCHS = 20
RATE = 30.0
DECAY = 1e-6
THRESHOLD = 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # Platt's
    offset: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -500, 500)))


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """(word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    continued = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))  # UTF-8 continuation bytes
    word_chars = len(text) - continued - sum(map(text.count, (SPACES[i : i + 1] for i in range(len(SPACES)))))
    symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more, first included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    n = Counter(windows)
    often = np.fromiter((n[w] > 1 for w in windows), dtype=bool, count=len(windows))
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= often
    return int(inside.sum())


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_by_label: dict[int, int], seed: int = 0) -> Model:
    """Stochastic gradient descent on three quarters of ``rows``; the rest calibrates."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = order[: len(order) // 4], order[len(order) // 4 :]
    weights, bias = np.zeros(BUCKETS), 0.0
    squares = np.full(BUCKETS, 1e-6)
    steps, step = max(1, EPOCHS * len(used)), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(used):
            label, at, share = rows[r]
            now = RATE * (1 - step / steps)
            step += 1
            z = float(share @ weights[at]) + bias
            g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
            grad = g * share
            squares[at] += grad * grad
            weights[at] -= now * 0.05 * grad / np.sqrt(squares[at]) + now * DECAY * weights[at]
            bias -= 0.01 * now * 0.05 * g
    z = np.array([float(rows[r][2] @ weights[rows[r][1]]) + bias for r in held])
    y = np.array([rows[r][0] for r in held], dtype=float)
    prior = {k: n_by_label.get(k, 0) + 1.0 for k in (0, 1)}
    seen = {k: float((y == k).sum()) + 1.0 for k in (0, 1)}
    weight = np.where(y == 1, prior[1] / seen[1], prior[0] / seen[0])
    slope, offset = _platt(z, y, weight / weight.sum() * max(1, len(y)))
    return Model(weights, bias, slope, offset)


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that maximise the likelihood of smoothed targets, by Newton's method."""
    if not len(z):
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * (beta - np.array([1.0, 0.0]))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Learn from the labelled rows that ``use`` (a condition on ``labels``) admits."""
    texts, n = subwords.sample(docs, labels, label_col, per_label, use, id_col, text_col)
    return train(subwords.sample_counts(texts, BUCKETS, SHORTEST, LONGEST, True), n)


def apply(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of ``docs``, the base counts, base_failed, kept and score, which replace columns of their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS numbers
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = without(keep, [*names, "base_failed", "score", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache, weights = _cache(model), model.weights
        for batch in slices(batches):
            rows = np.zeros((batch.num_rows, 5), dtype=np.int64)
            z = np.full(batch.num_rows, model.bias)
            for i, text in enumerate(text_bytes(batch, text_col)):
                words = text.split() if text else []
                if not words:
                    if text:
                        rows[i, 1:] = base_counts(text, words)
                    continue
                rows[i] = len(words), *base_counts(text, words)
                total = cache.total(words)
                two = pairs_sum(words, weights)
                z[i] += (total.real + two) / (total.imag + len(words) - 1)
            failed = (rows[:, 0] < MIN_WORDS) | (100 * rows[:, 4] > MAX_REPEAT_PERCENT * rows[:, 0])
            score = model.probability(z)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(rows[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], [*keep, *names, "base_failed", "kept", "score"])

    schema = extend(docs.select(*keep).schema, ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, score double")
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def pairs_sum(words: list[bytes], weights: np.ndarray) -> float:
    return float(weights[subwords.pairs(words) & np.uint32(len(weights) - 1)].sum()) if len(words) > 1 else 0.0


_CACHES: dict[int, tuple[Model, subwords.WordWeights]] = {}


def _cache(model: Model) -> subwords.WordWeights:
    """Weights of words under the worker's current model; a new model replaces the old one's."""
    if id(model) not in _CACHES or _CACHES[id(model)][0] is not model:
        _CACHES.clear()
        _CACHES[id(model)] = (model, subwords.WordWeights(model.weights, SHORTEST, LONGEST))
    return _CACHES[id(model)][1]
