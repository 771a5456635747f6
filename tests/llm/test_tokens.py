"""BPE against the tokenizers library, chat formatting by reading back."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import DATA
from tessella.llm import bpe, chat, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.vocabulary(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding(both, text):
    own, library = both
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "  \n\n x", "a" * 5000, "\u0085   x", "I'll don't 'S"])
def test_special_cases(both, text):
    own, library = both
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query(spark, both):
    library = both[1]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = registry.op3_bpe(spark, str(DATA)).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_columns_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "héllo", 3)], "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.text or "", r.decoded) for r in out.collect()) == [("", ""), ("", ""), ("héllo", "héllo")]
    assert bpe.digests(df.limit(0), PATH).count() == 0
    assert [r.n_tokens for r in bpe.digests(df, PATH).collect()].count(0) == 2
    cut = spark.createDataFrame([([bpe.vocabulary(PATH).ids[b"\xc3"]],)], "ids array<int>")
    assert bpe.decode(cut, PATH).first().decoded == "�"


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


pieces = st.lists(st.sampled_from(["[INST]", " [/INST]", "</s>", "<s>", "\\", "[ROLE x]", "[ASST]", " ", "word", "é", "\n", "[/ROLE]", "[SYS] "]), max_size=6).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool use", "", "a]b"]), pieces), max_size=12), st.integers(1, 30), st.integers(0, 20))
def test_windows_read_back(turns, budget, history):
    found = list(chat.windows(((r, t, len(chat.render(r, t)[0].split())) for r, t in turns), 2, budget, history))
    back, loss = [], ""
    for w in found:
        parsed = chat.parse(w["text"])
        back += parsed[w["n_repeated"] :]
        loss += "".join(chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"])
        assert w["over_budget"] == (w["n_tokens"] > budget)
        if w["over_budget"]:
            system = sum(r == "system" for r, _ in parsed[: w["n_repeated"]])
            assert len(parsed) - w["n_repeated"] == 1 and w["n_repeated"] == system
    assert back == turns
    assert loss == "".join(t for r, t in turns if r == "assistant")


def test_chat_query(spark):
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = registry.op6_chat(spark, str(DATA)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == {k: digest(v) for k, v in turns.items()}


def test_chat_edges(spark):
    rows = [(None, 0, "user", None, 9), (None, None, None, "x", 9), (1, 0, "assistant", "b", 9), (1, 0, "assistant", "a", 9), (1, 0, "assistant", "a", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, window int")
    made = chat.format_windows(df, chat.word_counter, budget=6, history=2)
    found = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert found == {None: digest([("", "x"), ("user", "")]), 1: digest([("assistant", "a"), ("assistant", "a"), ("assistant", "b")])}
    assert chat.read_back(chat.format_windows(df.limit(0), chat.word_counter)).count() == 0
