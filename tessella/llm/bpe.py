"""Byte-level BPE encoding and decoding.

Encoding keeps the symbols of a word in a doubly linked list and the candidate
merges in a priority queue ordered by (rank, position).  Popped entries whose
symbols have changed since they were pushed are stale and skipped.  Decoding
concatenates the byte strings of the vocabulary.

The vocabulary is a ``tokenizers`` JSON file whose path is a parameter; each
Python worker reads it once.  On a cluster the path must exist on every
executor (installed package, or shipped with ``SparkContext.addFile``).

Nulls and empty texts give zero tokens and the empty decoded text.  Texts of
any length are encoded whole; memory follows the longest single text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import slices, text_bytes, without

#: The published word pattern of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words whose ids a Python worker keeps; beyond it the memory starts anew.
CACHED_WORDS = 500_000

#: Longer words are encoded anew each time, so that the cache's size is bounded in bytes.
CACHED_WORD_BYTES = 64


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others get the code
    points from 256 on, in order.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteBpe(dict):
    """Word (bytes) -> its ids as little-endian uint32 bytes, filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = printable_bytes()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {as_bytes(piece): i for piece, i in spec["model"]["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): rank for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        by_id = {i: piece for piece, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.words = regex.compile(WORD_PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted((s.decode() for s in self.special), key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = np.array(self.merge(raw), dtype="<u4").tobytes()
        if len(raw) <= CACHED_WORD_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        if (whole := self.ids.get(word)) is not None and len(word) == 1:
            return [whole]
        n, ranks = len(word), self.ranks
        symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(rank, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbol[i] is not left or j >= n or symbol[j] is not right:
                continue  # stale: one of the two has been merged meanwhile
            symbol[i], symbol[j], after[i] = left + right, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (rank := ranks.get((symbol[i], symbol[after[i]]))) is not None:
                    heapq.heappush(queue, (rank, i, symbol[i], symbol[after[i]]))
            if (k := before[i]) >= 0 and (rank := ranks.get((symbol[k], symbol[i]))) is not None:
                heapq.heappush(queue, (rank, k, symbol[k], symbol[i]))
        return [self.ids[s] for s in symbol if s is not None]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes; strings of special tokens are theirs."""
        if self.specials is None or not any(s.decode() in text for s in self.special):
            return b"".join(map(self.__getitem__, self.words.findall(text)))
        out = []
        for part in self.specials.split(text):
            if (i := self.special.get(part.encode())) is not None:
                out.append(np.array([i], dtype="<u4").tobytes())
            else:
                out.extend(map(self.__getitem__, self.words.findall(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes that the ids stand for."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    """The vocabulary of ``path``, read once per Python process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text in ``ids_col`` (array of int).

    A column of ``docs`` named ``ids_col`` is replaced.
    """
    kept = [docs.schema[n] for n in without(docs.columns, [ids_col])]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches):
            ids = [bpe.encode(t) if t else b"" for t in batch.column(text_col).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(offsets, values)], [*names, ids_col])

    return docs.select(*_distinct([*names, text_col])).mapInArrow(run, T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text that the ids stand for in ``text_col``; null ids give the empty text.

    Bytes that are not UTF-8 (ids cut in the middle of a character) become
    U+FFFD, as in the usual decoders.
    """
    kept = [tokens.schema[n] for n in without(tokens.columns, [text_col])]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches):
            texts = [bpe.decode(np.array(x or [], dtype="<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, text_col])

    return tokens.select(*_distinct([*names, ids_col])).mapInArrow(run, T.StructType([*kept, T.StructField(text_col, T.StringType())]))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, and the SHA-256 of the ids and of the decoded text.

    Encodes and decodes in one pass, so that neither ids nor texts leave the task.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in slices(batches):
            n, of_ids, of_text = [], [], []
            for raw in text_bytes(batch, text_col):
                ids = bpe.encode(raw.decode()) if raw else b""
                text = bpe.decode(ids)
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*_distinct([id_col, text_col])).mapInArrow(run, schema)


def _distinct(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in dict.fromkeys(names)]
