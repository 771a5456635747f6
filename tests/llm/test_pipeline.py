"""The whole pipeline against a brute-force version of its stages, with planted rows."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import decontaminate, langid, linededup
from tests.conftest import DATA
from tests.llm.test_duplicates import slow_components, slow_dedup, slow_fingerprint
from tests.llm.test_models import fold


def slow_leaks(text, items):
    """Whether a text repeats a window of an item, by comparing every diagonal whole."""
    have = (text or "").encode().lower().split()
    for want in items:
        n = len(want)
        if not n or not have:
            continue
        width = min(n, decontaminate.WINDOW)
        allowed = 0 if n < decontaminate.EXACT_TOKENS else min(decontaminate.MAX_SUBSTITUTIONS, n * decontaminate.MAX_SUBSTITUTIONS // decontaminate.WINDOW)
        number = {w: i for i, w in enumerate(want)}
        want_ids = np.array([number[w] for w in want])
        ids = np.array([-1] * (n - 1) + [number.get(w, -1) for w in have] + [-1] * (n - 1))
        same = np.lib.stride_tricks.sliding_window_view(ids, n) == want_ids
        sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        if ((sums[:, width:] - sums[:, :-width]) >= width - allowed).any():
            return True
    return False


def slow_pipeline(rows, model, items):
    """(id, text) of what the first four stages keep."""
    rows = [(i, t) for i, t in rows if not model.predict(t)[2]]
    before, cleaned = dict(rows), slow_dedup(rows)
    rows = [(i, t) for i, t in cleaned.items() if t == before[i] or t.encode().split()]
    prints, nodes = [slow_fingerprint(t.encode()) for _, t in rows], [i for i, _ in rows]
    roots = slow_components(prints, nodes)
    rows = [(i, t) for i, t in rows if roots[i] == i]
    return {i: t for i, t in rows if not slow_leaks(t, items)}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tests = spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = max((r.text for r in tests.collect()), key=lambda t: len(t.split()))
    copied = next(r.text for r in docs.orderBy("doc_id").collect() if r.text and 60 < len(r.text.split()) < 500)
    passage = " ".join(f"{w}" for w in copied.split()[:55][::-1])
    planted = [
        (900_001, None),
        (900_002, "日本語のテキストは学習されていない言語です" * 5),
        (900_003, copied),
        (900_004, f"{' '.join(copied.split()[5:25])} {item} {' '.join(copied.split()[30:40])}"),
        (900_005, f"{passage}\n{' '.join(copied.split()[::3])}"),
        (900_006, f"{' '.join(copied.split()[1::3])}\n{passage}"),
        (900_007, passage + "\n \n"),
    ]
    extra = spark.createDataFrame([(i, t, None, "planted", len(t or "")) for i, t in planted], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    tests.write.parquet(str(tmp_path / "benchmark.parquet"))

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    learned = spark.read.parquet(str(tmp_path / "documents.parquet")).where(~corpus_pipeline.F.coalesce(corpus_pipeline.split_bucket("doc_id", 4) == 2, corpus_pipeline.F.lit(False)))
    kept = slow_pipeline(rows, langid.fit(learned), [(r.text or "").encode().lower().split() for r in tests.collect()])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        expected[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == expected
    assert not {900_001, 900_002, 900_003, 900_004} & set(found)
    assert {i for i, _ in rows if i < 900_000} & set(found) and {fold(i, 4) for i in found} == {0, 1, 2, 3}
    first, second = (kept.get(900_005), kept.get(900_006))
    assert passage in first and passage not in (second or "") and 900_007 not in found
    assert len(passage.split()) >= linededup.LONG_LINE


def test_stages_keep_the_columns(spark):
    """All stages but the last return the columns of their input, of an empty table too."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).count() == 0
