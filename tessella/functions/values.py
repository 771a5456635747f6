"""Scalar functions on sizes, times and texts, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit prefixes in order of magnitude.
PREFIXES = "KMGTPEZY"
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}

_SIZE = r"^\s*([+-]?)\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([KMGTPEZYkmgtpezy]?)(i?)[Bb]?\s*$"
_NUMBER = r"^\s*([+-]?)([0-9]+(?:\.[0-9]+)?)\s*([smhd]?)\s*$"
_CLOCK = r"^\s*([+-]?)([0-9]+):([0-9]{1,2}):([0-9]{1,2})\s*$"


def expand_size(text: Column) -> Column:
    """Bytes of ``10M``, ``1.5GiB``, ``-3k`` or a bare number; K is 1000, Ki 1024.  Null if it is no size."""
    prefix = F.upper(F.regexp_extract(text, _SIZE, 3))
    binary = F.regexp_extract(text, _SIZE, 4) != ""
    power = F.when(prefix == "", 0).otherwise(F.instr(F.lit(PREFIXES), prefix))
    factor = F.pow(F.when(binary, 1024.0).otherwise(1000.0), power)
    number = F.regexp_extract(text, _SIZE, 2).try_cast("double") * factor
    signed = F.when(F.regexp_extract(text, _SIZE, 1) == "-", -number).otherwise(number)
    return F.when(text.rlike(_SIZE), F.round(signed).cast("bigint"))


def expand_time(text: Column, unit: str = "s") -> Column:
    """Seconds of ``HH:MM:SS`` or a number with s, m, h or d (``unit`` if bare); a sign may lead.  Null if it is no time."""
    part = lambda i: F.regexp_extract(text, _CLOCK, i).try_cast("bigint")
    clock = part(2) * 3600 + part(3) * 60 + part(4)
    letter = F.regexp_extract(text, _NUMBER, 3)
    scale = reduce(lambda done, kv: done.when(letter == kv[0], kv[1]), SECONDS.items(), F.when(letter == "", SECONDS[unit]))
    plain = F.round(F.regexp_extract(text, _NUMBER, 2).try_cast("double") * scale).cast("bigint")
    negative = text.rlike(r"^\s*-")
    value = F.when(text.rlike(_CLOCK), clock).when(text.rlike(_NUMBER), plain)
    return F.when(negative, -value).otherwise(value)


def format_hms(seconds: Column) -> Column:
    """``HH:MM:SS`` of a number of seconds, zero-padded."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def format_duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds that are not zero; ``0s`` if all are."""
    s = seconds.cast("bigint")
    parts = [(F.floor(s / 86400), " day"), (F.floor(s / 3600) % 24, " hr"), (F.floor(s / 60) % 60, " min"), (s % 60, " sec")]
    words = F.concat_ws(" ", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts))
    return F.when(s <= 0, "0s").otherwise(words)


def format_duration_short(seconds: Column) -> Column:
    """The two largest units, without seconds unless they are all there is."""
    s = seconds.cast("bigint")
    parts = [(F.floor(s / 86400), " day"), (F.floor(s / 3600) % 24, " hr"), (F.floor(s / 60) % 60, " min")]
    shown = F.filter(F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts)), lambda x: x.isNotNull())
    return F.when(s <= 0, "0s").when(s < 60, F.concat(s.cast("string"), F.lit(" sec"))).otherwise(F.array_join(F.slice(shown, 1, 2), " "))


def pretty_size(n: Column) -> Column:
    """``n`` bytes with a 1024-based unit; more decimals the larger the unit, at most two."""
    power = F.when(n < 1024, 0)
    for k in range(1, 5):
        power = power.when(n < 1024 ** (k + 1), k)
    power = power.otherwise(5)
    value = n / F.pow(F.lit(1024.0), power)
    unit = F.concat(F.substring(F.lit(" " + PREFIXES), power + 1, F.lit(1)), F.lit("B"))
    return F.when(power == 0, F.concat(n.cast("string"), F.lit("B"))).when(power == 1, F.concat(F.format_string("%.1f", F.round(value, 1)), unit)).otherwise(F.concat(F.format_string("%.2f", F.round(value, 2)), unit))


def short_repr(text: Column, limit: int = 80) -> Column:
    """At most ``limit`` characters; a longer text ends in three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def natural_key(text: Column) -> Column:
    """A key under which runs of digits sort by value: padded to 19 places."""
    pieces = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 19, "0")).otherwise(p)), "")


def text_md5(text: Column) -> Column:
    return F.md5(text)


#: Terminal escapes and the markup that stands for them.
ANSI = {"\x1b[32m": '<span class="green">', "\x1b[94m": '<span class="blue">', "\x1b[95m": '<span class="purple">', "\x1b[91m": '<span class="red">', "\x1b[36m": '<span class="cyan">', "\x1b[0m": "</span>", "\n": "<br>\n"}


def ansi_to_html(text: Column) -> Column:
    return reduce(lambda done, kv: F.replace(done, F.lit(kv[0]), F.lit(kv[1])), ANSI.items(), text)


def dehtml(page: Column) -> Column:
    """Plain text: runs of white space are one space, <p> starts a paragraph, <br> a line, <li> a bullet; tags go.

    Scripts and styles are not removed; their text stays.
    """
    steps = [(r"\s+", " "), (r"(?i)<p(?:\s[^>]*)?>", "\n\n\n\n"), (r"(?i)<br\s*/?>", "\n\n"), (r"(?i)<li(?:\s[^>]*)?>", " - "), (r"(?i)</(?:ul|ol)\s*>", "\n\n"), (r"(?s)<!--.*?-->", ""), (r"<[^>]*>", "")]
    plain = reduce(lambda done, s: F.regexp_replace(done, *s), steps, page)
    named = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
    return F.trim(reduce(lambda done, s: F.replace(done, F.lit(s[0]), F.lit(s[1])), named, plain))


def natural_ticks(low: Column, high: Column) -> Column:
    """Powers of ten across a positive range of three decades or more; null otherwise."""
    first, last = F.floor(F.log10(low)).cast("int"), F.ceil(F.log10(high)).cast("int")
    return F.when((low > 0) & (last - first >= 3), F.transform(F.sequence(first, last), lambda k: F.pow(F.lit(10.0), k)))


def partial_md5(content: Column, size: Column, whole_below: int = 16 << 20, part: int = 8 << 20) -> Column:
    """MD5 of a file: of all its content if small, else of its first and last parts."""
    ends = F.concat(F.substring(content, 1, part), F.substring(content, F.length(content) - part + 1, F.lit(part)))
    return F.md5(F.when(size < whole_below, content).otherwise(ends))
