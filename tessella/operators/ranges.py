"""Which steps of a workflow a reference names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_ranges(index: Column, ranges: str) -> Column:
    """``3``, ``-5``, ``3-``, ``2-4`` and lists of them, ends included."""
    out = F.lit(False)
    for part in ranges.split(","):
        m = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", part)
        if not m or not (m[1] or m[3]):
            raise ValueError(f"{part!r} is no range of steps")
        if not m[2]:
            out = out | (index == int(m[1]))
        else:
            out = out | ((index >= int(m[1] or 0)) & (index <= int(m[3])) if m[3] else index >= int(m[1]))
    return out


def named_like(name: Column, pattern: str) -> Column:
    """Names under a wildcard pattern of ``*`` and ``?``."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return name.like(escaped.replace("*", "%").replace("?", "_"))
