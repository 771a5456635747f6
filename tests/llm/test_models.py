"""Learned operators: accuracy held out, and exact parts against brute force."""

import collections
import math
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessella.llm import html, langid, lm, quality, registry, rules, subwords

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def documents(spark, d):
    return {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}


@pytest.mark.parametrize("opening", ["<body class='post has-sidebar'>", "<body class=no-sidebar>", "<body id=page class='nav-open'>", "<body><main class='has-comments'>", "<body><article class='share-enabled'>", "<body><div class='content has-sidebar'>", "<body><div class='content-with-sidebar'>", "<body><div class='hasSidebar'>"])
def test_html_names_of_state_and_layout(opening):
    text = "The whole article, in a long sentence of its own, with words enough to be read."
    assert html.main_text(f"<html>{opening}<p>{text}</p><div class='site-nav'><p>Home</p></div><div class='sidebar'><p>More</p></div>") == text


def test_language(spark):
    docs = documents(spark, SF)
    found = registry.op4_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if fold(i, 4) == 2}
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in held]) < 0.02 and all(0 <= r.score <= 1 for r in found)


def test_language_rejects_and_edges(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "日本語のテキストは学習されていない言語です" * 3), (5, "zzqx kkwvq xxjq qqzk vvkx jjqz xkcd zqzq wvxk qjqj " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].rejected for i in (1, 2, 3))
    assert found[4].rejected and found[5].rejected and found[4].lang_pred in model.langs
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(df, empty, ["doc_id"]).first().lang_pred == "und"


def test_language_rejects_long_texts(spark):
    """Unknown languages are rejected in sizes of which there are few or no labelled texts."""
    model = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    letters = np.array([chr(x) for x in range(0x4E00, 0x4E00 + 3000)])
    for n in (2_000, 20_000, 100_000):
        assert model.predict("".join(np.random.default_rng(n).choice(letters, n)))[2], n


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    found = [r for r in registry.op5_quality(spark, d).collect() if r.doc_id in labels]
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.96  # n-grams do not see a word that repeats the one before
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (2, "*** $$$", "x"), (3, None, "x"), (4, "", "x"), (None, "y", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (1, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    found = quality.predict(docs, model, ["doc_id"]).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    nothing = quality.fit(docs, labels.limit(0), F.lit(True))
    assert quality.predict(docs.limit(0), nothing, ["doc_id"]).count() == 0 and quality.predict(docs, nothing, ["doc_id"]).count() == 5


def test_folded_weights_are_the_network(spark):
    rows = [(k % 2, *subwords.counts(t, quality.BUCKETS, 3, 5, False)) for k, t in enumerate([b"aa bb cc", b"xx xx yy", b"aa cc", b"yy xx"] * 5)]
    model = quality.train(rows, {0: 10, 1: 10})
    words = subwords.WordWeights(model.weights, 3, 5)
    for label, at, share in rows:
        assert (model.offset + share @ model.weights[at] > 0) == (label == 1)
    total = words.total(b"xx xx yy".split())
    at, share = subwords.counts(b"xx xx yy", quality.BUCKETS, 3, 5, False)
    assert math.isclose(total.real / total.imag, share @ model.weights[at], rel_tol=1e-9)


def slow_rules(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_rules(spark):
    docs = documents(spark, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = registry.op8_rules(spark, SF).collect()
    for r in found:
        n, chars, symbols, dup, again = slow_rules(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and (not r.kept or not r.base_failed)
    held = [r for r in found if fold(r.doc_id, 4) == 2 and r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in held]) > 0.9  # n-grams do not see a word that repeats the one before


@pytest.mark.parametrize("text", [None, "", " \n\t", "a a a a", "é # ü\né # ü\n\n\n", "a b c a b c", "x\x1cy z w", "a\n a\na"])
def test_rules_edges(spark, text):
    model = rules.Model(np.zeros(rules.BUCKETS), 0.0, 1.0, 0.0)
    df = spark.createDataFrame([(1, text, "z")], "doc_id long, text string, kept string")
    assert tuple(rules.apply(df, model, ["doc_id"]).first())[1:6] == slow_rules(text)


def test_calibration():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    slope, offset = rules._platt(z, y, np.ones(4000))
    assert abs(slope - 2) < 0.3 and abs(offset + 1) < 0.2


# -- pages -------------------------------------------------------------------------------------


def test_pages(spark):
    import html as std
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = registry.op2_html(spark, str(DATA)).collect()
    assert len(found) == len(pages)
    for r in found:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [" ".join(std.unescape(re.sub(r"<[^>]+>", "", q.replace("<br>", " "))).split()) for q in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<", ""), ("<div", ""),
    ('<article><p>One &lt;two&gt; &amp; &#233;&#x41;.</p><div class="ad"><p>Buy now, cheap.</p></div><p>Three\n  four.</p></article>', "One <two> & éA.\nThree four."),
    ("<body><nav><a href=1>Home</a></nav><article><h1>T</h1><p>Long text here, with words.<p>Second, open.</article><footer>c</footer>", "T\nLong text here, with words.\nSecond, open."),
    ('<article><p>Body text, it is here.</p><section class="comments"><p>I like this. Very much so.</p></section></article>', "Body text, it is here."),
    ("<article><p>A<script>if (a < b) x('</p>')</script> b <b>c</b>d.</p><style>p{}</style><form><p>Name: <input></p><button>Go</button></form></article>", "A b cd."),
    ('<div class="sidebar"><p>Many words stand in the sidebar, for sure.</p></div><div class="content"><p>Many words stand in the content, for sure.</p></div>', "Many words stand in the content, for sure."),
    ('<main><div role="alert">Note: we changed, please read.</div><p>The text itself, which is long enough.</p></main>', "The text itself, which is long enough."),
    ("<article><p>Unclosed <b>bold text, here", "Unclosed bold text, here"),
    ("<article><!-- <p>no</p> --><p>yes, this one.</p><p hidden>not, that one.</p></article>", "yes, this one."),
])
def test_page_cases(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    # Neutral names: structure and text decide.
    ("<div class=x1><div class=x2><a href=/>Home</a><a href=/b>About us</a></div><div class=x3><h1>A title of some words</h1><p>The first paragraph has a number of words that make a sentence.</p><p>Yes.</p>"
     "<p>Another paragraph with enough words to be seen as text by everyone.</p></div><div class=x4><p>&copy; 2024 Some company</p></div></div>",
     "A title of some words\nThe first paragraph has a number of words that make a sentence.\nYes.\nAnother paragraph with enough words to be seen as text by everyone."),
    # A bad name alone does not outweigh a text of the article.
    ("<article><p>one two three four five six seven eight nine ten.</p><p class='message'>a message of some length, which is text of the article.</p><p>eleven more words to come after it in the article here.</p></article>",
     "one two three four five six seven eight nine ten.\na message of some length, which is text of the article.\neleven more words to come after it in the article here."),
    # Broken markup loses no text and shows no code.
    ("<p>start of text is here.</p><button>go <p>the rest of it is here too, with words.", "start of text is here.\ngo\nthe rest of it is here too, with words."),
    ("<p>shown text of some words, long enough.</p><select><p>the rest of it is here too, with words.", "shown text of some words, long enough.\nthe rest of it is here too, with words."),
    ("<p>A text of some words, which ends in a broken <a href=\"x>link", "A text of some words, which ends in a broken link"),
    ("<script src='x'/><p>shown text of some words, long enough to be read.</p>", "shown text of some words, long enough to be read."),
    ("<script src='x'/>var code = 1;</script><p>shown text of some words, long enough to be read.</p>", "shown text of some words, long enough to be read."),
    ("<svg><svg><text>a</text></svg><text>b</text></svg><p>shown text of some words, long enough to be read.</p>", "shown text of some words, long enough to be read."),
])
def test_page_evidence(page, text):
    assert html.main_text(page) == text


def test_smoothness_decides(spark):
    """Without smoothness edges blocks of real pages change sides, and only for the worse."""
    import re

    changed = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        page = html.parse(r.html)
        with_edges, alone = html.label(page), html.label(page, 0.0)
        if with_edges != alone:
            changed += 1
            inside = [b.text for b in html.parse(re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]).blocks]
            assert [b.text for b, c in zip(page.blocks, with_edges, strict=True) if c] == inside
            assert [b.text for b, c in zip(page.blocks, alone, strict=True) if c] != inside
    assert changed


def test_deep_page_is_linear():
    import time

    def seconds(n):
        page, start = "</i>".join(f"<div>t{k} </b>" for k in range(n)), time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(16000) < 40 * max(0.05, seconds(1000))


def test_minimum_cut_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        source, sink = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, n).tolist()
        edges = [(int(a), int(b), int(rng.integers(0, 6))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: E731, B023
        best = min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert cost(html.minimum_cut(source, sink, edges)) == best


def test_large_page():
    page = "<article>" + "<p>Some words, and more of them.</p><nav><a>x</a></nav>" * 3000 + "</article>"
    assert html.main_text(page).count("\n") == 2999


# -- language model ----------------------------------------------------------------------------


def test_lm_query(spark):
    docs = documents(spark, str(DATA))
    counts = collections.Counter()
    for i, r in docs.items():
        if fold(i, 5) != 1:
            counts.update([*(r.text or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    found = registry.op9_lm(spark, str(DATA)).collect()
    assert len(found) == len(docs)
    for r in found:
        words = [*(docs[r.doc_id].text or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 5) == 1, len(words), sum(w in counts for w in words), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in found if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) / tokens > math.log10(2)  # at most half the base's perplexity


def slow_model(texts, burn_in, samples):
    """One bucket and one part, without Spark: {(context id, token id): probability} and the totals."""
    numbers, starts, own = lm._Numbers(), [], []
    for text in texts:
        starts.append(len(own))
        own += [numbers[w] for w in [*text.encode().split(), lm.END]]
    asks = pa.Table.from_batches(lm._block_rows(numbers, starts, np.array(own), np.ones(len(texts), bool), 0, lm.Shape(1, 1), lm._PLAIN))
    shape, totals, sampled, kinds = lm.Shape(1, 1), lm.Totals(), [], lambda x, *k: x.filter(pc.is_in(x.column("_kind"), pa.array(k, pa.int32())))
    told = lambda x: [d for *_, d in lm._data(x, lm._TOTAL)]
    held = lm._merge(asks, shape)
    lm._add_contexts(told(held), totals, True)
    parent = lm._seat_words(kinds(held, lm._WORDS), held, totals, 0, False)
    lm._add_parent(told(parent), totals, True)
    seats, answers = held, parent
    for sweep in range(1, burn_in + samples + 1):
        seats = lm._reseat(seats, lm._as_seated(answers, totals, sweep), totals, shape, sweep, sweep > burn_in)
        lm._add_contexts(told(seats), totals, False)
        parent = lm._seat_words(kinds(parent, lm._MODEL), seats, totals, sweep, sweep > burn_in)
        lm._add_parent(told(parent), totals, False)
        answers = parent
        if sweep > burn_in:
            sampled.append(replace(totals))
    words = lm._answer_words(parent, held)
    model = lm._data(held, lm._MODEL)[0][-1]
    p, u, _ = lm.pair_probabilities(model, lm._data(seats, lm._SEATS)[0][-1], [d for *_, d in lm._data(words, lm._PARENT)], sampled)
    names = {lm._word_id(w): w.decode() for w in numbers} | {lm.START_ID: ""}
    return {(names[int(model[0][i])], names[int(model[2][j])]): x for i, j, x in zip(u, model[3], p, strict=True)}, totals


def gibbs_by_customer(texts, d, d0, strength, sweeps, seed):
    """The same model, one customer after another, with all tables kept; probabilities of the pairs seen, averaged over sweeps."""
    rng = np.random.default_rng(seed)
    customers = [(a, b) for t in texts for a, b in zip(["", *t.split()], [*t.split(), "\n"])]
    vocabulary = {b for _, b in customers}
    base = 1 / (len(vocabulary) + 1)
    rest, root = collections.defaultdict(list), []  # tables: [dish, customers]

    def parent_p(w):
        n, t = sum(k for _, k in root), len(root)
        return (sum(k - d0 for x, k in root if x == w) + (strength + d0 * t) * base) / (strength + n)

    def sit(tables, w, discount, p):
        at = [k for k, x in enumerate(tables) if x[0] == w]
        weights = np.array([*(tables[k][1] - discount for k in at), (strength + discount * len(tables)) * p])
        k = rng.choice(len(weights), p=weights / weights.sum())
        if k < len(at):
            tables[at[k]][1] += 1
            return False
        tables.append([w, 1])
        return True

    def leave(tables, w):
        at = [k for k, x in enumerate(tables) if x[0] == w]
        weights = np.array([tables[k][1] for k in at])
        k = at[rng.choice(len(at), p=weights / weights.sum())]
        tables[k][1] -= 1
        if not tables[k][1]:
            del tables[k]
            return True
        return False

    total = collections.Counter()
    for sweep in range(sweeps + 20):
        for a, b in customers:
            if sweep and leave(rest[a], b):
                leave(root, b)
            if sit(rest[a], b, d, parent_p(b)):
                sit(root, b, d0, base)
        if sweep >= 20:
            for a, b in set(customers):
                n, t = sum(k for _, k in rest[a]), len(rest[a])
                total[a, b] += (sum(k - d for x, k in rest[a] if x == b) + (strength + d * t) * parent_p(b)) / (strength + n) / sweeps
    return total


TINY = ["a b a b a c", "a b b a b", "c a b c c", "", "b a a b a b a b"] * 3


def test_lm_against_a_sampler_of_single_customers():
    found, totals = slow_model(TINY, 20, 400)
    expected = gibbs_by_customer(TINY, totals.discount, totals.root_discount, lm.STRENGTH, 400, 1)
    assert set(found) == {k if k[1] != "\n" else k for k in expected}
    for k, p in expected.items():
        assert abs(found[k] - p) < 0.01 + 0.03 * p, k


def test_lm_is_a_distribution():
    """In every context the probabilities of all tokens and of the unknown add up to one."""
    every = [f"{a} {b}" for a in "abc" for b in "abc"] + list("abc") + [""]
    found, totals = slow_model([*TINY, *every, *every], 3, 2)  # every pair of words occurs
    unknown_root = (lm.STRENGTH + totals.root_discount * totals.tables) / (totals.vocabulary + 1) / (lm.STRENGTH + totals.customers)
    sums = collections.Counter()
    for (a, _), p in found.items():
        sums[a] += p
    assert all(0.97 < x < 1 for x in sums.values())  # the rest is the unknown's: its share of the back-off
    assert all(1 - x < unknown_root * 4 for x in sums.values())


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.75, 0.95])
def test_stirling_numbers(discount):
    """Recursion against enumerated seatings, and the forms for large counts against the recursion."""
    exact = lm.stirling(600, discount)
    for c in range(1, 7):
        by_tables = collections.Counter()

        def seat(k, sizes, weight, c=c, by_tables=by_tables):
            if k == c:
                by_tables[len(sizes)] += weight
                return
            for i, n in enumerate(sizes):
                seat(k + 1, [*sizes[:i], n + 1, *sizes[i + 1 :]], weight * (n - discount))
            seat(k + 1, [*sizes, 1], weight)

        seat(0, [], 1.0)
        assert np.allclose(np.exp(exact[c, 1 : c + 1]), [by_tables[t] for t in range(1, c + 1)])
    t = np.arange(1, 601, dtype=float)
    off = np.abs(lm.stirling_large(np.array([600.0]), t[None, :], discount)[0] - exact[600, 1:])
    assert off[t <= 600**discount].max() < 1e-3 and off.max() < 0.35 and off.mean() < 0.03


@pytest.mark.parametrize(("c", "p", "others"), [(2, 0.2, 10), (7, 0.05, 300), (150, 0.01, 3000), (500, 0.001, 40), (500, 0.02, 9000)])
def test_draws_are_from_the_conditional(c, p, others):
    d, n = 0.7, 20000
    t = np.arange(1, c + 1)
    logs = lm.stirling(c, d)[c, 1:] + t * math.log(p) + np.r_[0, np.cumsum(np.log(lm.STRENGTH + d * (others + t[:-1])))]
    exact = np.exp(logs - logs.max())
    exact /= exact.sum()
    drawn = lm.Draw(d)(np.full(n, c), np.full(n, p), np.full(n, float(others)), np.random.default_rng(2).random(n))
    mean = (exact * t).sum()
    sd = math.sqrt((exact * t * t).sum() - mean**2)
    assert abs(drawn.mean() - mean) < 0.02 * mean + 4 * sd / math.sqrt(n) and abs(drawn.std() - sd) < 0.05 * sd + 0.02


def test_lm_layout_changes_nothing(spark):
    """Many blocks, buckets and split contexts give the scores of one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 5 != 1, ["doc_id"]).collect()}
    shape = lm._shape(docs, "text", 3000, 4000)
    assert shape.buckets > 4 and shape.split
    many = lm.score(docs.repartition(3), F.col("doc_id") % 5 != 1, ["doc_id"], block_tokens=3000, bucket_tokens=4000).collect()
    assert len(many) == len(one)
    for r in many:
        assert math.isclose(r.score, one[r.doc_id].score, rel_tol=1e-9) and math.isclose(r.base_score, one[r.doc_id].base_score, rel_tol=1e-9)
        assert tuple(r)[1:4] == tuple(one[r.doc_id])[1:4]


def test_lm_words_of_context_help(spark):
    """Held-out texts are likelier than under the parent alone, that is with all contexts held out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = lm.perplexity(lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, ["doc_id"]).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 1)).first()
    assert found.perplexity < 0.5 * found.base_perplexity


def test_lm_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "new words", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c int")
    found = lm.score(df, F.lit(False), ["doc_id"]).collect()
    assert len(found) == 4 and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in found)
    found = lm.score(df, F.lit(True), ["doc_id", "c"], block_tokens=2).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 1, 3] and all(r.score < 0 for r in found) and sorted(r.c for r in found) == [1, 2, 2, 3]
    assert lm.score(df.limit(0), F.lit(True), ["doc_id"]).count() == 0
    assert lm.perplexity(lm.score(df, F.col("doc_id").isNotNull(), ["doc_id"])).first().perplexity > 1
    long = spark.createDataFrame([(1, "w " * 20000), (2, "w w w")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in lm.score(long, F.col("doc_id") == 1, ["doc_id"]).collect()) == [(1, 20001, 20001), (2, 4, 4)]


def test_clashing_columns(spark):
    """Columns that carry the names of new ones are replaced; others are kept, whatever their names."""
    docs = spark.createDataFrame([(1, "some words here", "x", "y", 5), (2, None, "x", None, None)], "doc_id long, text string, score string, _marks string, fp int")
    model = langid.fit(docs.withColumn("lang", F.lit("en")))
    assert langid.predict(docs, model, docs.columns).columns == ["doc_id", "text", "_marks", "fp", "lang_pred", "score", "rejected"]
    assert langid.keep_known(docs, model).columns == docs.columns and [r.doc_id for r in langid.keep_known(docs, model).collect()] == [1]
    flat = rules.Model(np.zeros(rules.BUCKETS), 0.0, 1.0, 0.0)
    assert rules.apply(docs, flat, docs.columns).count() == 2
    assert quality.predict(docs, quality.Model(np.zeros(quality.BUCKETS), 0.0), docs.columns).first().score == 0.5
    assert html.extract(docs.withColumn("html", F.lit("<p>x")), docs.columns).columns == ["doc_id", "score", "_marks", "fp", "text", "n_chars"]
    from tessella.llm import linededup, simhash

    assert linededup.remove_repeats(docs).columns == [*docs.columns, "n_chunks_removed", "n_words_removed"]
    assert simhash.deduplicate(docs).columns == docs.columns and simhash.deduplicate(docs).count() == 2
    named = docs.withColumn("_text", F.lit("t")).withColumn("_block", F.lit(1))
    scored = lm.score(named, F.lit(True), ["doc_id", "_text", "_block", "score"])
    assert scored.columns == ["doc_id", "_text", "_block", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and scored.count() == 2
