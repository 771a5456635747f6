"""SimHash, line dedup and decontamination against brute force, and the pipeline."""

from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from tessella.llm import components, decontaminate, linededup, registry, simhash


def slow_fingerprint(text):
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(zip(nodes, prints, strict=True), 2):
        if (x ^ y).bit_count() <= 3:
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return {n: find(n) for n in nodes}


def test_position_sets():
    assert len(simhash.POSITION_SETS) == 14
    for five in combinations(range(8), 5):
        assert any(set(s) <= set(five) for s in simhash.POSITION_SETS)
    for level in simhash._LEVELS:
        assert len({m.bit_count() for m in level}) <= 2
    assert min(m.bit_count() for m in simhash._LEVELS[-1]) >= 50


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbé \t\n\x0b\x1c ", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text.encode())


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text)


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    prints = [slow_fingerprint((r.text or "").encode()) for r in docs]
    roots = slow_components(prints, [r.doc_id for r in docs])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op1_simhash(spark, str(DATA)).collect()}
    assert found == {r.doc_id: (f"{p:016x}", roots[r.doc_id]) for r, p in zip(docs, prints, strict=True)}


@pytest.mark.parametrize("max_list", [2, 5, 2048])
def test_links_with_long_lists(spark, max_list):
    """Near copies by the hundred, through every level of refinement."""
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for base in list(prints)[:3]:
        for _ in range(60):
            x = base
            for b in rng.integers(0, 64, rng.integers(1, 8)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    nodes = list(range(len(prints)))
    df = spark.createDataFrame([(simhash._signed(p), n) for p, n in zip(prints, nodes, strict=True)], "fp long, node long")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(df, max_list=max_list)).collect()}
    assert {n: roots.get(n, n) for n in nodes} == slow_components(prints, nodes)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        i, j = sorted((find(a), find(b)))
        root[j] = i
    df = spark.createDataFrame(edges, "src long, dst long")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in components.connected_components(df).collect()} == {x: find(x) for x in linked}


def test_long_chain(spark):
    df = spark.range(60).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.root for r in components.connected_components(df).collect()} == {0}


def test_simhash_edges(spark):
    rows = [(None, "a b c d", 1), (1, None, 1), (2, "", 1), (3, "  \n", 1), (4, "A B C D", 1), (4, "A B C D", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    print_ = f"{slow_fingerprint(b'a b c d'):016x}"
    assert found == [((False, 1), "0" * 16, 1), ((False, 2), "0" * 16, 1), ((False, 3), "0" * 16, 1), ((False, 4), print_, 4), ((False, 4), print_, 4), ((True, 0), print_, 4)]
    assert sorted((r.doc_id or 0) for r in simhash.deduplicate(df).collect()) == [0, 1, 4, 4]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, "x y z")], "doc_id long, text string")
    assert simhash.near_duplicates(only_null).first().component_id is None


# -- lines -------------------------------------------------------------------------------------


def slow_dedup(rows, long_line=50):
    """Texts less their repeated pairs of lines and long lines, found by comparing the lines themselves, one document after another."""
    had, out = {}, {}
    for i, t in sorted(rows):
        lines = (t or "").encode().split(b"\n")
        words = [k for k, x in enumerate(lines) if x.split()]
        gone = set()
        spans = [(a, b) for a, b in zip(words, words[1:])] + [(k, k) for k in words if len(lines[k].split()) >= long_line]
        for a, b in spans:
            content = (lines[a],) if a == b else (lines[a], lines[b])
            if had.setdefault(content, (i, a)) != (i, a):
                gone |= set(range(a, b + 1))
        out[i] = b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode() if t else t
    return out


def test_linededup_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = {r.doc_id: r.text for r in registry.op7_linededup(spark, str(DATA)).collect()}
    assert found == slow_dedup(rows)
    assert found != dict(rows)


def test_boundaries_do_not_shift(spark):
    """Lines put in before, inside and after a shared passage leave all its other chunks repeated."""
    lines = [f"line {i} of a passage" for i in range(200)]
    other = ["new", *lines[:90], "other", *lines[90:], "last"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "doc_id long, text string")
    found = {r.doc_id: r for r in linededup.remove_repeats(df).collect()}
    assert found[1].text == "\n".join(lines) and found[2].text == "new\nother\nlast" and found[2].n_chunks_removed == 2


def test_linededup_two_texts_of_an_id(spark):
    rows = [(1, "a b\nc d\ne f"), (2, "x\na b\nc d"), (2, "a b\nnew\nc d"), (3, "one\ntwo"), (3, "one\ntwo")]
    found = sorted((r.doc_id, r.text) for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, "a b\nc d\ne f"), (2, "a b\nnew\nc d"), (2, "x"), (3, "one\ntwo"), (3, "one\ntwo")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", " ", "a", "b c", "d", "w " * 60]), max_size=9).map("\n".join), min_size=1, max_size=6))
def test_linededup_brute_force(spark, texts):
    rows = list(enumerate(texts))
    found = {r.doc_id: r.text for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == slow_dedup(rows)


def test_long_lines_stay_if_asked(spark):
    long = " ".join(f"w{j}" for j in range(60))
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")
    assert [r.text for r in linededup.remove_repeats(df, long_line=None).collect()] == [long, long]


def test_linededup_passages(spark):
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(55)) for k in range(3))
    short = " ".join(f"s{j}" for j in range(12))
    lines = "\n".join(" ".join(f"q{k}x{j}" for j in range(22)) for k in range(3))  # 66 words in lines of 22
    rows = [(i, f"own words of {i}\n{passage}\nthe end of {i}\n{short}\nthen {i}\n{lines}", "x") for i in range(5)] + [(9, None, "x"), (10, "", "x"), (None, passage, "x"), (11, "clean text\nof two lines", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chunks_removed string")
    found = {r.doc_id: r for r in linededup.remove_repeats(df).collect()}
    assert found[0].text == rows[0][1] and found[9].text is None and found[10].text == "" and found[11].text == rows[-1][1] and found[None].text == passage
    for i in range(1, 5):
        assert "p0w0" not in found[i].text and "q2x21" not in found[i].text and f"own words of {i}" in found[i].text and short in found[i].text
        assert found[i].n_words_removed == 3 * 55 + 66 and found[i].n_chunks_removed == 2
    assert linededup.remove_repeats(df.limit(0)).count() == 0


def test_linededup_repeats_inside_and_repeated_rows(spark):
    long = " ".join(f"w{j}" for j in range(60))  # a stretch of its own
    df = spark.createDataFrame([(1, f"{long}\n{long}"), (2, long), (2, long)], "doc_id long, text string")
    found = sorted((r.doc_id, r.text) for r in linededup.remove_repeats(df).collect())
    assert found == [(1, long), (2, ""), (2, "")]


def slow_runs(rows, long_line=50):
    """Every run of two or more lines, or of one long line, compared with every one before it."""
    lines = {i: [x for x in t.encode().split(b"\n") if x.split()] if t else [] for i, t in rows}
    first, out = {}, {}
    runs = {i: [(a, b) for a in range(len(x)) for b in range(a + 1, min(a + 4, len(x) + 1)) if b > a + 1 or len(x[a].split()) >= long_line] for i, x in lines.items()}
    for i, x in lines.items():
        for a, b in runs[i]:
            first[tuple(x[a:b])] = min(first.get(tuple(x[a:b]), (i, a)), (i, a))
    for i, x in lines.items():
        gone = {k for a, b in runs[i] if first[tuple(x[a:b])] != (i, a) for k in range(a, b)}
        out[i] = [line.decode() for k, line in enumerate(x) if k not in gone]
    return out


def test_linededup_passages_of_short_lines(spark):
    """Whole passages of lines of any length go, with their first and last lines."""
    rows, size = [], [(6, 9), (6, 10), (5, 12), (5, 15), (4, 15), (3, 19), (8, 10), (10, 10), (11, 5)]
    for k, (n, width) in enumerate(size):
        passage = "\n".join(" ".join(f"p{k}l{i}w{j}" for j in range(width)) for i in range(n))
        for copy in range(4):
            rows.append((10 * k + copy, f"own {k} {copy} a\nown {k} {copy} b\n{passage}\nown {k} {copy} c\nown {k} {copy} d"))
    long, twelve = " ".join(f"x{j}" for j in range(40)), " ".join(f"y{j}" for j in range(12))
    rows += [(900 + i, f"own {i}\n{long}\n\n{twelve}\nend {i}") for i in range(3)]
    rows += [(950 + i, f"one line\nown {i}") for i in range(2)]
    found = {r.doc_id: r.text for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        own = [x for x in text.split("\n") if x.startswith(("own", "end"))]
        assert found[i] == (text if i in (900, 950, 951) or i < 900 and i % 10 == 0 else "\n".join(own)), i


def test_linededup_against_all_runs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = {r.doc_id: r.text for r in registry.op7_linededup(spark, str(DATA)).collect()}
    assert {i: [x for x in (t or "").split("\n") if x.encode().split()] for i, t in found.items()} == slow_runs(rows)


def test_linededup_compares_bytes(spark, monkeypatch):
    """Under a hash that always collides nothing that differs is removed."""
    import sys

    from pyspark import cloudpickle

    a, b = " ".join(f"a{j}" for j in range(60)), " ".join(f"b{j}" for j in range(60))
    cloudpickle.register_pickle_by_value(sys.modules["tessella.llm.linededup"])
    try:
        monkeypatch.setattr(linededup, "_digest", lambda line: b"0123456789abcdef")
        df = spark.createDataFrame([(1, a), (2, b), (3, "c\nd"), (4, "e\nf")], "doc_id long, text string")
        assert sorted((r.doc_id, r.text) for r in linededup.remove_repeats(df).collect()) == [(1, a), (2, b), (3, "c\nd"), (4, "e\nf")]
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules["tessella.llm.linededup"])


# -- leaks -------------------------------------------------------------------------------------


def test_masks_find_every_overlap():
    def hit(good):
        return any(all(good[at + k] for k in m) for m in decontaminate.MASKS for at in range(len(good) - m[-1]))

    for n in range(decontaminate.EXACT_TOKENS, decontaminate.WINDOW + 1):
        allowed = min(2, n * decontaminate.MAX_SUBSTITUTIONS // decontaminate.WINDOW)
        for k in range(allowed + 1):
            for bad in combinations(range(n), k):
                assert hit([i not in bad for i in range(n)])


def test_leaks_query(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    cols = ["doc_id", "item_id", "n_tokens", "n_matched", "first_token"]
    expected = sorted(duck.sql(registry.ORACLES["op10_decontaminate"]).df()[cols].values.tolist())
    assert sorted(map(list, registry.op10_decontaminate(spark, str(DATA)).select(cols).collect())) == expected


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_leaks_with_substitutions(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_DIAGONALS", limit)
    item = [f"i{k}" for k in range(20)]
    swapped = [("X" if k in (3, 9) else w) for k, w in enumerate(item)]
    worse = [("X" if k % 4 == 0 else w) for k, w in enumerate(item)]
    tests = spark.createDataFrame([(7, " ".join(item), "x"), (8, "too short", "x"), (11, "b i0 I1", "x"), (9, None, "x"), (7, " ".join(item), "x")], "item_id long, text string, doc_id string")
    rows = [(1, "a b " + " ".join(item).upper() + " c"), (2, " ".join(swapped)), (3, " ".join(worse)), (4, None), (5, ""), (6, "clean " * 30), (None, " ".join(item)), (1, "a b " + " ".join(item).upper() + " c"), (10, " ".join(item[6:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    found = sorted(tuple(r) for r in decontaminate.leaks(docs, tests).collect())
    assert found == [(1, 7, 20, 20, 2), (1, 11, 3, 3, 1), (2, 7, 20, 18, 0), (10, 7, 20, 14, 0)]
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminate(docs, tests).collect()) == [0, 3, 4, 5, 6]
    assert decontaminate.leaks(docs.limit(0), tests).count() == 0 and decontaminate.leaks(docs, tests.limit(0)).count() == 0


def test_short_items_match_whole(spark, tmp_path):
    """Items of one to seven tokens, in SQL and in the query."""
    words = ["red", "green", "blue"]
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(40)]
    items = [(k, " ".join(rng.choice(words, k))) for k in range(12)] + [(20, None), (21, "red green red")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cols = ["doc_id", "item_id", "n_tokens", "n_matched", "first_token"]
    expected = sorted(duck.sql(registry.ORACLES["op10_decontaminate"]).df()[cols].values.tolist())
    found = sorted(map(list, registry.op10_decontaminate(spark, str(tmp_path)).select(cols).collect()))
    assert found == expected and {r[1] for r in found} >= {1, 2, 3}


def test_count_filter_comes_first():
    """Of all pairs tallied only those with enough shared bytes have their bits counted, and some of them are dropped then."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    near = base[:20] ^ np.uint64(0b111)  # three bits in a byte
    far = base[20:] ^ np.uint64(0xFF)  # eight bits in a byte: enough bytes, too many bits
    seen = {}
    edges = simhash.forest(np.concatenate([base, near, far]), seen=seen)
    assert len(edges) == 20 and seen["tallied"] > 10 * seen["verified"] and seen["verified"] >= 40
    assert (simhash.shared_bytes(base[:1], near[:1])[0, 0], simhash.shared_bytes(base[20:21], far[:1])[0, 0]) == (7, 7)


def test_deduplicate_by_row(spark):
    rows = [(1, "a b c d e", 0), (2, "a b c d e", 0), (2, "something else is written here", 1), (2, "something else is written here", 2), (None, "a b c d e", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert sorted(tuple(r)[2] for r in simhash.deduplicate(df).collect()) == [0, 1, 2, 3]
    assert simhash.deduplicate(df).columns == df.columns


def test_no_python_in_the_plan(spark):
    plan = registry.op10_decontaminate(spark, str(DATA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
