"""Queries of patterns and of the functions on paths, sizes, times and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths, patterns, values
from tessella.functions.ordinal import with_ordinal
from tessella.plans import tables as t
from tessella.plans.query import query


@query("SELECT s_suppkey, regexp_extract(s_name, '^(.+)#(.+)$', 1) AS kind, regexp_extract(s_name, '^(.+)#(.+)$', 2) AS num FROM supplier")
def extract_pattern(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.extract(F.col("s_name"), "{kind}#{num}")
    return t.table(spark, d, "supplier").select("s_suppkey", *(c.alias(n) for n, c in found.items()))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, 'Brand#([1-9])') THEN regexp_extract(p_brand, '^Brand#([1-9])$', 1) END AS digit FROM part")
def extract_constrained(spark: SparkSession, d: str) -> DataFrame:
    """Names that do not match give null."""
    return t.table(spark, d, "part").select("p_partkey", patterns.extract(F.col("p_brand"), "Brand#{digit,[1-9]}")["digit"].alias("digit"))


@query("SELECT page_id, CASE WHEN regexp_full_match(url, 'https?://([^/]+)/([a-z]{2})/([0-9]+).*') THEN regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/([0-9]+)', 1) END AS host, CASE WHEN regexp_full_match(url, 'https?://([^/]+)/([a-z]{2})/([0-9]+).*') THEN regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/([0-9]+)', 2) END AS lang FROM pages")
def extract_url(spark: SparkSession, d: str) -> DataFrame:
    found = patterns.extract(F.col("url"), "{scheme,https?}://{host,[^/]+}/{lang,[a-z]{2}}/{number,[0-9]+}{rest,.*}", raw=True)
    return t.table(spark, d, "pages").select("page_id", found["host"].alias("host"), found["lang"].alias("lang"))


@query("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || '/' || c_mktsegment || '_' || c_name || '.txt' AS name FROM customer")
def expand_pattern(spark: SparkSession, d: str) -> DataFrame:
    name = patterns.apply("{nation}/{segment}_{name}.txt", {"nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment"), "name": F.col("c_name")})
    return t.table(spark, d, "customer").select("c_custkey", name.alias("name"))


_PATHS = "p AS (SELECT p_partkey, '/data/' || p_type || '/' || replace(p_name, ' ', '.') || '.' || CAST(p_size AS VARCHAR) || CASE WHEN p_size % 3 = 0 THEN '.gz' ELSE ' b' END AS path FROM part)"


@query(f"""WITH {_PATHS} SELECT p_partkey, regexp_extract(path, '[^/]*$') AS b, regexp_replace(path, '/[^/]*$', '') AS d, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS bn, regexp_extract(path, '\\.[^.]*$') AS x,
replace(path, ' ', '\\ ') AS e, CASE WHEN path LIKE '% %' THEN '''' || path || '''' ELSE path END AS q FROM p""")
def path_formats(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, ".gz").otherwise(" b"))
    named = t.table(spark, d, "part").select("p_partkey", path.alias("path"))
    return named.select("p_partkey", *(paths.format_path(F.col("path"), spec).alias(spec) for spec in ("b", "d", "bn", "x", "e", "q")))


@query("""SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1048576 ELSE -p_size * 1000000000 END AS BIGINT) AS bytes FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""")
def size_parse(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("p_size").cast("string"), F.col("p_size") % 4
    text = F.when(s == 0, n).when(s == 1, F.concat(n, F.lit("K"))).when(s == 2, F.concat(n, F.lit("MiB"))).otherwise(F.concat(F.lit("-"), n, F.lit(" GB")))
    return t.table(spark, d, "part").select("p_partkey", values.expand_size(text).alias("bytes"))


@query("""SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN p_size * 86400 WHEN 1 THEN p_size * 3600 WHEN 2 THEN p_size * 60 + 5 ELSE -(3600 + p_size * 60 + 30) END AS BIGINT) AS seconds FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""")
def time_parse(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("p_size").cast("string"), F.col("p_size") % 4
    text = F.when(s == 0, n).when(s == 1, F.concat(n, F.lit("h"))).when(s == 2, F.concat(F.lit("00:"), n, F.lit(":05"))).otherwise(F.concat(F.lit("-1:"), n, F.lit(":30")))
    return t.table(spark, d, "part").select("p_partkey", values.expand_time(text, "d").alias("seconds"))


@query("SELECT o_orderkey, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS hms FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)")
def hms_format(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "orders").select("o_orderkey", values.format_hms(F.floor("o_totalprice")).alias("hms"))


@query("""SELECT o_orderkey, CASE WHEN s <= 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN s // 86400 > 0 THEN CAST(s // 86400 AS VARCHAR) || ' day' END, CASE WHEN s // 3600 % 24 > 0 THEN CAST(s // 3600 % 24 AS VARCHAR) || ' hr' END,
CASE WHEN s // 60 % 60 > 0 THEN CAST(s // 60 % 60 AS VARCHAR) || ' min' END, CASE WHEN s % 60 > 0 THEN CAST(s % 60 AS VARCHAR) || ' sec' END) END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)""")
def duration_format(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "orders").select("o_orderkey", values.format_duration(F.floor("o_totalprice")).alias("shown"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER), p_partkey) - 1 AS ord FROM part")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    keyed = t.table(spark, d, "part").select("p_partkey", values.natural_key(F.col("p_brand")).alias("k"))
    return with_ordinal(keyed, "k", "p_partkey", name="ord").select("p_partkey", "ord")


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def text_md5(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", values.text_md5(F.col("text")).alias("md5"))


@query("SELECT doc_id, md5(CASE WHEN strlen(text) < 2000 THEN text ELSE left(text, 0) || decode(encode(text)[1:1000]) || decode(encode(text)[strlen(text) - 999:strlen(text)]) END) AS md5 FROM documents WHERE strlen(text) = length(text)")
def file_md5(spark: SparkSession, d: str) -> DataFrame:
    """Content hash of whole small files and of both ends of large ones, here those of one-byte characters."""
    docs = t.table(spark, d, "documents").where(F.octet_length("text") == F.length("text"))
    content = F.col("text").cast("binary")
    return docs.select("doc_id", values.partial_md5(content, F.octet_length("text"), 2000, 1000).alias("md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS shown FROM documents")
def short_repr(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", values.short_repr(F.col("text")).alias("shown"))


@query("SELECT doc_id, base64(encode(text)) AS b64 FROM documents")
def base64_text(spark: SparkSession, d: str) -> DataFrame:
    # Spark breaks lines after 76 characters by default; plain base64 has none.
    return t.table(spark, d, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\\r\\n]", "").alias("b64"))


_DEHTML = "html"
for _old, _new in ((r"\s+", " "), (r"(?i)<p(?:\s[^>]*)?>", "\n\n\n\n"), (r"(?i)<br\s*/?>", "\n\n"), (r"(?i)<li(?:\s[^>]*)?>", " - "), (r"(?i)</(?:ul|ol)\s*>", "\n\n"), (r"(?s)<!--.*?-->", ""), (r"<[^>]*>", "")):
    _DEHTML = f"regexp_replace({_DEHTML}, '{_old}', '{_new}', 'g')"
for _old, _new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _DEHTML = f"replace({_DEHTML}, '{_old}', '{_new}')"


@query(f"SELECT page_id, trim({_DEHTML}, ' ') AS text FROM pages")
def dehtml(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "pages").select("page_id", values.dehtml(F.col("html")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || 'B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024.0, 1)) || 'KB' ELSE printf('%.2f', round(n / 1048576.0, 2)) || 'MB' END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 7) AS n FROM orders)")
def pretty_size(spark: SparkSession, d: str) -> DataFrame:
    n = (F.floor("o_totalprice") * (F.col("o_orderkey") % 7)).cast("bigint")
    return t.table(spark, d, "orders").select("o_orderkey", values.pretty_size(n).alias("shown"))
