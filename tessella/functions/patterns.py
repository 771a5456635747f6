"""Name patterns: ``{name}`` wildcards extracted from names and expanded into names.

``{name}`` matches greedily, ``{name,regex}`` what the regex does, and a name
that comes again must match the same text.  A pattern has to match a whole
name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WILDCARD = re.compile(r"\{(\w+)(?:,((?:[^{}]|\{\d+(?:,\d*)?\})+))?\}")


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """A Java regex, and the names of its groups in order."""
    names: list[str] = []
    out, at = [], 0
    for m in _WILDCARD.finditer(pattern):
        out.append(re.escape(pattern[at : m.start()]))
        if m[1] in names:
            out.append(f"\\{names.index(m[1]) + 1}")
        else:
            names.append(m[1])
            out.append(f"({re.sub(r'(?<!\\)[(](?![?])', '(?:', m[2]) if m[2] else '.+'})")
        at = m.end()
    out.append(re.escape(pattern[at:]))
    return f"^{''.join(out)}$", names


def normalise_slashes(pattern: str) -> str:
    return re.sub(r"(?<!^)/{2,}", "/", pattern) if not pattern.startswith("//") else re.sub(r"/{2,}", "/", pattern)


def extract(name: Column, pattern: str, raw: bool = False) -> dict[str, Column]:
    """A column for each wildcard; null where the name does not match.

    Repeated slashes of the pattern collapse and back-slashes of names count as
    slashes, unless ``raw``.
    """
    regex, names = compile_pattern(pattern if raw else normalise_slashes(pattern))
    subject = name if raw else F.replace(name, F.lit("\\"), F.lit("/"))
    return {n: F.when(subject.rlike(regex), F.regexp_extract(subject, regex, i + 1)) for i, n in enumerate(names)}


def apply(pattern: str, values: dict[str, Column]) -> Column:
    """The pattern with its wildcards replaced by columns; a missing value is an error."""
    parts, at = [], 0
    for m in _WILDCARD.finditer(pattern):
        if m[1] not in values:
            raise KeyError(f"no value for wildcard {m[1]!r}")
        parts += [F.lit(pattern[at : m.start()]), values[m[1]].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))
