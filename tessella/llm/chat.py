"""Chat formatting in budgeted windows.

The turns of a conversation are cut into windows of whole turns.  Prefix sums
of the turns' tokens choose the spans: a window takes new turns while they,
the leading system turns and the repeated history fit ``budget`` tokens; the
next window repeats the leading system turns (those within half the budget)
and as many of the last turns as fit ``history`` tokens; the marks at both ends
of a window count too.  Assistant texts are the targets; the loss mask covers
each once, in the window where it is new, and never its repetition.  A turn
that alone exceeds the budget gets a window without history.

Template: ``[SYS] text [/SYS]``, ``[INST] text [/INST]``, ``[ASST] text [/ASST]``
for system, user and assistant turns, ``[ROLE name] text [/ROLE]`` for others,
one after another between ``<s>`` and ``</s>``.  A control string inside a text
gets one more back-slash in front than it has; reading back takes it away.

Tokens are counted where the turns lie; only the sums and windows of one
conversation are made in order by one task, which holds no more of its turns
than a window does, however long the conversation is.  Null texts
and roles are empty; null conversation ids form one conversation; equal turn
numbers go by role and text; repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import extend, free_name

BUDGET = 2048
HISTORY = 512

_ROLES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", "[/ASST]")}
_CONTROL = r"</?s>|\[/?(?:SYS|INST|ASST|ROLE)\]|\[ROLE [^\]\s]*\]"
_ESCAPE = regex.compile(rf"(\\*)({_CONTROL})")
_UNESCAPE = regex.compile(rf"\\(\\*)({_CONTROL})")
_TURN = regex.compile(r"(?<!\\)\[(SYS|INST|ASST|ROLE [^\]\s]*)\] (.*?) (?<!\\)\[/(?:SYS|INST|ASST|ROLE)\]", regex.S)
_NAMES = {"SYS": "system", "INST": "user", "ASST": "assistant"}

_WINDOW = "window int, text string, n_tokens long, n_repeated int, loss array<struct<start:int,end:int>>, over_budget boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn, and where its escaped text starts and ends."""
    start, end = _ROLES.get(role) or (f"[ROLE {quote(role, safe='')}]", "[/ROLE]")
    body = escape(text)
    return f"{start} {body} {end}", len(start) + 1, len(start) + 1 + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    return [(_NAMES.get(m[1]) or unquote(m[1][5:]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def windows(turns: Iterator[tuple[str, str, int]], ends: int, budget: int, history: int) -> Iterator[dict]:
    """The windows of one conversation, from its turns (role, text, tokens when formatted) in order; ``ends``: tokens of the marks around a window."""
    given, budget = budget, budget - ends
    system: list[tuple] = []  # (role, rendered, tokens)
    past: list[tuple] = []  # turns before the window that may be repeated
    new: list[tuple] = []
    number, opening, repeated_system = 0, True, 0

    def span(turns: list[tuple], limit: int) -> list[tuple]:
        """The longest tail of ``turns`` within ``limit`` tokens, by prefix sums from the end."""
        total, first = 0, len(turns)
        while first and total + turns[first - 1][2] <= limit:
            first -= 1
            total += turns[first][2]
        return turns[first:]

    def emit() -> dict:
        repeated = [*system[:repeated_system], *past]
        text, loss = "<s>", []
        for i, (role, (body, a, b), _) in enumerate([*repeated, *new]):
            if role == "assistant" and i >= len(repeated):
                loss.append({"start": len(text) + a, "end": len(text) + b})
            text += body
        n = ends + sum(t[2] for t in (*repeated, *new))
        return {"window": number, "text": text + "</s>", "n_tokens": n, "n_repeated": len(repeated), "loss": loss, "over_budget": n > given}

    used = 0
    for role, text, tokens in turns:
        turn = (role, render(role, text), tokens)
        if opening and role == "system" and sum(t[2] for t in system) + turn[2] <= budget // 2:
            system.append(turn)
        else:
            opening = False
        if new and used + turn[2] > budget:
            yield emit()
            number, repeated_system = number + 1, len(system)
            room = budget - sum(t[2] for t in system) - turn[2]
            tail = [t for t in (*past, *new) if not any(t is s for s in system)]
            past, new = span(tail, min(history, room)), []
            used = sum(t[2] for t in (*system, *past))
        new.append(turn)
        used += turn[2]
    if new:
        yield emit()


def format_windows(turns: DataFrame, count: Callable[[], Callable[[str], int]], budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, window, text, n_tokens, n_repeated, loss, over_budget) of every window.

    ``count`` makes, in a task, the function that counts the tokens of a
    formatted turn.  ``loss`` holds code-point spans of the text;
    ``n_repeated`` leading turns are repetitions.  Windows of a conversation
    are together and in order inside a partition.
    """
    schema = extend(T.StructType([turns.schema[conv_col]]), _WINDOW)

    key_type = _arrow_type(turns, conv_col)

    named = [conv_col, turn_col, role_col, text_col]
    size = free_name(named, "_tokens")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = count()
        for batch in batches:
            n = [counter(render(role or "", text or "")[0]) for role, text in zip(batch.column(role_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = count()
        ends = counter("<s>") + counter("</s>")
        for part in _batched(_all_windows(_rows(batches), ends, budget, history), 64):
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], key_type), *(pa.array([p[1][n] for p in part], t) for n, t in _ARROW)], [conv_col, *(n for n, _ in _ARROW)])

    with_size = turns.select(named).mapInArrow(counted, extend(turns.select(named).schema, f"`{size}` long"))
    ordered = with_size.repartition(conv_col).sortWithinPartitions(*named)
    return ordered.select(conv_col, F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit("")), size).mapInArrow(run, schema)


_ARROW = [("window", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_repeated", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("over_budget", pa.bool_())]


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator, n: int) -> Iterator[list]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, iterator of the rows of that key) for neighbouring rows, read as they come."""
    rows = iter(rows)
    head = next(rows, None)
    while head is not None:
        key, rest = head[0], []

        def same(first: tuple, key: object = key, rest: list = rest) -> Iterator[tuple]:
            yield first
            for row in rows:
                if row[0] != key:
                    rest.append(row)
                    return
                yield row

        group = same(head)
        yield key, group
        for _ in group:
            pass
        head = rest[0] if rest else None


def _all_windows(rows: Iterator[tuple], ends: int, budget: int, history: int) -> Iterator[tuple]:
    for conv, turns in _grouped(rows):
        for window in windows((r[1:] for r in turns), ends, budget, history):
            yield conv, window


def read_back(formatted: DataFrame, conv_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``in_order``: the windows come straight from ``format_windows``.
    """
    if not in_order:
        formatted = formatted.repartition(conv_col).sortWithinPartitions(conv_col, "window")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([formatted.schema[conv_col], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    key_type = _arrow_type(formatted, conv_col)

    def digest(parts: Iterator[tuple]) -> tuple:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        for _, text, n_repeated, spans in parts:
            for role, said in parse(text)[n_repeated:]:
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for s in spans:
                said = unescape(text[s["start"] : s["end"]])
                loss.update(said.encode())
                loss_chars += len(said)
            chars += len(text)
        return n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((conv, *digest(parts)) for conv, parts in _grouped(_rows(batches)))
        for part in _batched(found, 1000):
            cols = list(zip(*part, strict=True))
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [conv_col, *names])

    return formatted.select(conv_col, "text", "n_repeated", "loss").mapInArrow(run, schema)


def word_counter() -> Callable[[str], int]:
    """Counts white-space separated words."""
    return lambda text: len(text.split())


def bpe_counter(path: str) -> Callable[[], Callable[[str], int]]:
    """Counts tokens of a byte-level vocabulary."""

    def make() -> Callable[[str], int]:
        from tessella.llm.bpe import vocabulary

        bpe = vocabulary(path)
        return lambda text: len(bpe.encode(text)) // 4

    return make


def all_turns(conversations: DataFrame, extra: list[tuple], conv_col: str = "conv_id") -> DataFrame:
    """``conversations`` and literal (conv, turn, role, text) rows."""
    names = [conv_col, "turn", "role", "text"]
    schema = T.StructType([conversations.schema[n] for n in names])
    for field in schema.fields:
        field.nullable = True
    return conversations.select(*names).unionByName(conversations.sparkSession.createDataFrame(extra, schema))
