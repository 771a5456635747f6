import pytest
from pyspark.sql import functions as F

from tessella.functions import paths, patterns, values
from tessella.functions.ordinal import with_ordinal, with_rank_in


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "spec", "expected"), [
    ("/a/b/c.tar.gz", "b", "c.tar.gz"), ("/a/b/c.tar.gz", "d", "/a/b"), ("/a/b/c.tar.gz", "bn", "c.tar"), ("/a/b/c.tar.gz", "x", ".gz"), ("/a/.bashrc", "x", ""), ("/a/.bashrc", "n", "/a/.bashrc"),
    ("a/..b.c", "x", ".c"), ("c.txt", "d", "."), ("/c", "d", "/"), ("a b", "e", "a\\ b"), ("a b", "q", "'a b'"), ("a'b", "q", "'a'\"'\"'b'"), ("plain-1.2", "q", "plain-1.2"), ("", "q", "''"),
    ("~/x", "u", "/root/x"), ("/root/x", "U", "~/x"), ("/rooty", "U", "/rooty"), ("x/../y/./z", "a", "/work/y/z"), ("C:\\d\\e", "p", "/C/d/e"), ("it's", "r", "'it\\'s'"), ("/a.b/c", "x", ""), ("", "b", ""), ("...", "x", ""),
])
def test_paths(spark, text, spec, expected):
    assert value(spark, paths.format_path(F.lit(text), spec)) == expected


def test_path_lists(spark):
    xs = F.lit(["/a/x.c", "/b/y.d"])
    assert value(spark, paths.format_paths(xs, "bn")) == "x y"
    assert value(spark, paths.format_paths(xs, "b,")) == "x.c,y.d"
    with pytest.raises(ValueError):
        paths.format_path(F.lit("a"), "z")


@pytest.mark.parametrize(("name", "pattern", "expected"), [
    ("a-20.txt", "{name}-{par}.txt", {"name": "a", "par": "20"}), ("a-b-20.txt", "{name}-{par}.txt", {"name": "a-b", "par": "20"}), ("a.csv", "{name}.txt", {"name": None}),
    ("x_x", "{a}_{a}", {"a": "x"}), ("x_y", "{a}_{a}", {"a": None}), ("b12", "{l,[a-z]}{n,[0-9]{2}}", {"l": "b", "n": "12"}), ("d/e.f", "{p}//{q}", {"p": "d", "q": "e.f"}), ("d\\e", "{p}/{q}", {"p": "d", "q": "e"}),
    ("(a)+", "({x})+", {"x": "a"}), ("ab12", "{l,(a|b)+}{n}", {"l": "ab", "n": "12"}),
])
def test_patterns(spark, name, pattern, expected):
    found = patterns.extract(F.lit(name), pattern)
    assert {k: value(spark, c) for k, c in found.items()} == expected


def test_expand(spark):
    assert value(spark, patterns.apply("{a}/{b}.txt", {"a": F.lit("x"), "b": F.lit(3)})) == "x/3.txt"
    with pytest.raises(KeyError):
        patterns.apply("{a}{b}", {"a": F.lit(1)})


@pytest.mark.parametrize(("text", "expected"), [("100", 100), ("10M", 10_000_000), ("1GiB", 1 << 30), ("1.5k", 1500), ("-2 KB", -2000), ("x", None), ("", None), ("5b", 5)])
def test_sizes(spark, text, expected):
    assert value(spark, values.expand_size(F.lit(text))) == expected


@pytest.mark.parametrize(("text", "expected"), [("1h", 3600), ("90", 90), ("01:02:03", 3723), ("-1:30:00", -5400), ("2d", 172800), ("1.5m", 90), ("x", None)])
def test_times(spark, text, expected):
    assert value(spark, values.expand_time(F.lit(text))) == expected


def test_texts(spark):
    assert value(spark, values.format_hms(F.lit(3723))) == "01:02:03"
    assert value(spark, values.format_duration(F.lit(90061))) == "1 day 1 hr 1 min 1 sec"
    assert value(spark, values.format_duration(F.lit(0))) == "0s"
    assert value(spark, values.format_duration_short(F.lit(90061))) == "1 day 1 hr"
    assert value(spark, values.format_duration_short(F.lit(59))) == "59 sec"
    assert value(spark, values.short_repr(F.lit("x" * 100))) == "x" * 77 + "..."
    assert value(spark, values.ansi_to_html(F.lit("\x1b[91mno\x1b[0m"))) == '<span class="red">no</span>'
    assert value(spark, values.natural_ticks(F.lit(1.0), F.lit(1000.0))) == [1.0, 10.0, 100.0, 1000.0]
    assert value(spark, values.natural_ticks(F.lit(1.0), F.lit(50.0))) is None
    assert value(spark, values.dehtml(F.lit("a<br>b &lt; c"))) == "a\n\nb < c"
    keys = [value(spark, values.natural_key(F.lit(x))) for x in ("a2", "a10", "a010b", "b1")]
    assert keys == sorted(keys)


def test_ordinals(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 20) for i in range(20)] + [(None, 99)], "k int, v int").repartition(5)
    assert [(r.v, r.idx) for r in with_ordinal(df, "v").orderBy("v").collect()] == [(v, v) for v in range(20)] + [(99, 20)]
    ranked = with_rank_in(df, "k", "v").collect()
    for k in (None, 0, 1, 2):
        own = sorted((r.v, r.rank) for r in ranked if r.k == k)
        assert [x for _, x in own] == list(range(len(own)))
    assert with_ordinal(df.limit(0), "v").count() == 0
