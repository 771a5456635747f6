"""Quality classifier: supervised subword embeddings.

Every word has a vector, and so has every hashed character n-gram; a document
is the average of all vectors of its words and their n-grams; a softmax layer
turns it into the probabilities of label 0 and 1.  Vectors and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample:
about ``SAMPLE_PER_LABEL`` documents of each label, chosen by a hash of the id.
The share of the labels among all labelled rows then corrects the offset.

As average and layer are linear, each feature's vector enters a score only by
one number, its product with the layer; the scoring pass uses that number.

Null and empty texts get the score of the labels' shares alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tessella.llm import subwords
from tessella.llm.common import extend, slices, text_bytes, without

BUCKETS = 1 << 16
DIMENSIONS = 16
SHORTEST, LONGEST = 3, 5
SAMPLE_PER_LABEL = 1000
EPOCHS = 8
RATE = 4.0
THRESHOLD = 0.7


@dataclass
class Model:
    weights: np.ndarray  # by bucket: vector times (layer of label 1 - layer of label 0)
    offset: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_by_label: dict[int, int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
    """Embeddings and softmax layer by stochastic gradient descent, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer, bias = rng.uniform(-0.1, 0.1, (2, DIMENSIONS)), np.zeros(2)
    seen = np.bincount([y for y, _, _ in rows], minlength=2).astype(float) if rows else np.zeros(2)
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            label, at, share = rows[r]
            now = rate * (1 - step / steps)
            step += 1
            if not len(at):
                continue
            mean = share @ vectors[at]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= now * np.outer(p, mean)
            bias -= 0.1 * now * p
            vectors[at] -= now * share[:, None] * back[None, :]
    prior = [n_by_label.get(y, 0) + 1.0 for y in (0, 1)]
    balance = np.log(prior[1] / prior[0]) - np.log((seen[1] + 1) / (seen[0] + 1))
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0] + balance))


def fit(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Learn from the labelled rows that ``use`` (a condition on ``labels``) admits."""
    texts, n = subwords.sample(docs, labels, label_col, per_label, use, id_col, text_col)
    return train(subwords.sample_counts(texts, BUCKETS, SHORTEST, LONGEST, False), n)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of ``docs``, score (probability of label 1) and predicted (int), which replace columns of their names."""
    keep = without(keep, ["score", "predicted"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = _cache(model)
        for batch in slices(batches):
            logits = np.full(batch.num_rows, model.offset)
            for i, text in enumerate(text_bytes(batch, text_col)):
                if text and (total := words.total(text.split())):
                    logits[i] += total.real / total.imag
            score = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    schema = extend(docs.select(*keep).schema, "score double, predicted int")
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


_CACHES: dict[int, tuple[Model, subwords.WordWeights]] = {}


def _cache(model: Model) -> subwords.WordWeights:
    """Weights of words under the worker's current model; a new model replaces the old one's."""
    if id(model) not in _CACHES or _CACHES[id(model)][0] is not model:
        _CACHES.clear()
        _CACHES[id(model)] = (model, subwords.WordWeights(model.weights, SHORTEST, LONGEST))
    return _CACHES[id(model)][1]
