"""Path and string formatters, as columns; one letter each, chained from left to right.

The letters and their meaning are a fixed interface: u expand home, U collapse
home, e escape spaces, a absolute, d directory, b base name, n without
extension, x extension, q shell quoting, p POSIX form, r quoted literal, s and R
as is; a comma makes ``join`` use it between elements.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_home(x: Column, home: str = "/root") -> Column:
    return F.when((x == "~") | x.startswith("~/"), F.concat(F.lit(home), F.substring(x, 2, 1 << 30))).otherwise(x)


def collapse_home(x: Column, home: str = "/root") -> Column:
    return F.when((x == home) | x.startswith(home + "/"), F.concat(F.lit("~"), F.substring(x, len(home) + 1, 1 << 30))).otherwise(x)


def escape_spaces(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit("\\ "))


def normalise(x: Column) -> Column:
    """Without empty, ``.`` and ``name/..`` parts, for absolute paths."""
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute(x: Column, cwd: str = "/work") -> Column:
    return normalise(F.when(x.startswith("/"), x).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), x)))


def directory(x: Column) -> Column:
    """Everything before the last slash; ``.`` if there is none, ``/`` for the root."""
    head = F.regexp_extract(x, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(~x.contains("/"), ".").when(head == "", "/").otherwise(head)


def base_name(x: Column) -> Column:
    return F.regexp_extract(x, "[^/]*$", 0)


def extension(x: Column) -> Column:
    """The last extension with its dot; leading dots start none."""
    return F.regexp_extract(x, r"(?s)^(?:.*/)?\.*[^./](?:[^/]*)?(\.[^./]*)$", 1)


def without_extension(x: Column) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - F.length(extension(x)))


def shell_quote(x: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(x.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), x).otherwise(quoted)


def posix(x: Column) -> Column:
    """Backslashes become slashes, and a drive letter a first directory."""
    slashed = F.replace(x, F.lit("\\"), F.lit("/"))
    return F.when(slashed.rlike("^[A-Za-z]:/"), F.concat(F.lit("/"), F.substring(slashed, 1, 1), F.substring(slashed, 3, 1 << 30))).otherwise(slashed)


def literal(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


FORMATS: dict[str, Callable[[Column], Column]] = {
    "u": expand_home, "U": collapse_home, "e": escape_spaces, "a": absolute, "d": directory, "b": base_name, "n": without_extension,
    "x": extension, "q": shell_quote, "p": posix, "r": literal, "s": lambda x: x, "R": lambda x: x, ",": lambda x: x,
}


def format_path(x: Column, spec: str) -> Column:
    """``x`` under the formatters of ``spec``, first letter first."""
    unknown = [c for c in spec if c not in FORMATS]
    if unknown:
        raise ValueError(f"unknown path format {unknown[0]!r}")
    return reduce(lambda done, c: FORMATS[c](done), spec, x)


def format_paths(xs: Column, spec: str) -> Column:
    """An array of paths under ``spec``, joined by a space, or by a comma if ``spec`` holds one."""
    return F.array_join(F.transform(xs, lambda x: format_path(x, spec)), "," if "," in spec else " ")


def add_text(x: Column, text: str) -> Column:
    return F.concat(x, F.lit(text))
