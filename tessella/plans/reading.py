"""Queries of readers, writers and streams: tables are written to the shared folder as files of each kind and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.targets import TargetSet
from tessella.plans import tables as t
from tessella.plans.query import query
from tessella.shared import shared_folder
from tessella.sources import files, stores
from tessella.streaming import pulses


#: Keys of customers whose cells stand in the same notebooks.
KEYS_PER_BOOK = 100_000


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessella-files-{uuid.uuid4().hex}"


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files of a catalogue: a folder for each nation, some of them hidden."""
    c = t.table(spark, d, "customer")
    path = F.concat(F.lit("/data/n"), F.col("c_nationkey").cast("string"), F.lit("/"), F.when(F.col("c_custkey") % 5 == 0, ".").otherwise(""), F.lit("c_"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".txt").otherwise(".csv"))
    return c.select(path.alias("path"), F.col("c_custkey").alias("size"))


_PATH = "f AS (SELECT '/data/n' || c_nationkey || '/' || CASE WHEN c_custkey % 5 = 0 THEN '.' ELSE '' END || 'c_' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.txt' ELSE '.csv' END AS path, c_custkey, c_nationkey FROM customer)"


@query(f"WITH {_PATH} SELECT row_number() OVER (ORDER BY path) - 1 AS idx, path AS name FROM f WHERE c_nationkey BETWEEN 10 AND 19 AND c_custkey % 5 <> 0 AND c_custkey % 2 = 0")
def glob_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets under a wildcard pattern, sorted by their bytes."""
    return TargetSet.glob(_catalogue(spark, d), "/data/n1?/c_*.txt").targets.select("idx", "name")


@query(f"WITH {_PATH} SELECT path, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey AS VARCHAR) AS num FROM f WHERE c_custkey % 5 <> 0 AND c_custkey % 2 = 1")
def matching_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose path has the form of a pattern, with its wildcards as columns."""
    return files.matching(_catalogue(spark, d), "/data/n{nation}/c_{num}.csv").select("path", "nation", "num")


@query(f"WITH {_PATH} SELECT path FROM f WHERE c_custkey % 5 <> 0")
def visible_files(spark: SparkSession, d: str) -> DataFrame:
    return _catalogue(spark, d).where(files.visible(F.col("path"), "/data")).select("path")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table written with a header and read with inferred types."""
    path = _folder(spark)
    t.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", "true").csv(path)
    return files.csv(spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment")


@query("SELECT count(*) AS n_lines, count(DISTINCT line) AS n_kinds, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (SELECT 'part ' || p_partkey || ' ' || p_name AS line FROM part)")
def compressed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of compressed text files."""
    path = _folder(spark)
    t.table(spark, d, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit(" "), "p_name").alias("value")).write.option("compression", "gzip").text(path)
    found = files.lines(spark, path)
    return found.agg(F.count("*").alias("n_lines"), F.count_distinct("text").alias("n_kinds"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT CAST(c_custkey % 4 AS VARCHAR) AS kernel, 'x = ' || c_custkey || chr(10) || 'print(x)' AS source FROM customer WHERE c_custkey % 3 <> 0")
def notebook_cells(spark: SparkSession, d: str) -> DataFrame:
    """Code cells of notebooks; every third cell is text.  A notebook, which is read whole, holds customers of one nation and stretch of keys."""
    path = _folder(spark)
    c = F.col("c_custkey")
    source = F.array(F.concat(F.lit("x = "), c.cast("string"), F.lit("\n")), F.lit("print(x)"))
    cell = F.struct(F.when(c % 3 == 0, "markdown").otherwise("code").alias("cell_type"), F.struct((c % 4).cast("string").alias("kernel")).alias("metadata"), source.alias("source"))
    books = t.table(spark, d, "customer").groupBy("c_nationkey", F.floor(c / KEYS_PER_BOOK)).agg(F.collect_list(cell).alias("cells"))
    books.select("cells").write.option("maxRecordsPerFile", 1).json(path)
    return files.notebook_cells(spark, path).select("kernel", "source")


@query("SELECT epoch_us(ts) // 1000000 AS second, value AS cpu, CAST(user_id AS BIGINT) AS mem, CAST(event_id % 7 AS INTEGER) AS nproc FROM events")
def pulse_files(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as tab-separated lines among comments."""
    path = _folder(spark)
    e = t.table(spark, d, "events")
    second = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    line = F.concat_ws("\t", F.concat(second, F.lit(".0")), F.col("value").cast("string"), F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string"), F.lit("0.0"), F.lit("0"))
    e.select(F.explode(F.array(F.lit("# a comment"), line)).alias("value")).write.text(path)
    return files.pulses(spark, path).select(F.unix_timestamp("ts").alias("second"), "cpu", "mem", "nproc")


@query("SELECT CAST(event_id AS DOUBLE) AS ts, event_type AS key, CAST(user_id AS VARCHAR) AS value FROM events")
def workflow_event_files(spark: SparkSession, d: str) -> DataFrame:
    """Key and value lines of workflow pulses among samples."""
    path = _folder(spark)
    line = F.concat(F.lit("#"), F.col("event_id").cast("string"), F.lit("\t"), "event_type", F.lit("\t"), F.col("user_id").cast("string"))
    t.table(spark, d, "events").select(F.explode(F.array(line, F.lit("1.0\t2.0"), F.lit("#no number\tx\ty"))).alias("value")).write.text(path)
    return files.workflow_events(spark, path).select("ts", "key", "value")


@query("SELECT 'r' || s_suppkey AS id, s_name AS seq, repeat('I', length(s_name)) AS qual FROM supplier")
def fastq_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of four lines each."""
    path = _folder(spark)
    s = t.table(spark, d, "supplier")
    s.select(F.concat_ws("\n", F.concat(F.lit("@r"), F.col("s_suppkey").cast("string")), "s_name", F.lit("+"), F.expr("repeat('I', length(s_name))")).alias("value")).write.text(path)
    return files.fastq(spark, path).select("id", "seq", "qual")


def _zipped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        contents = []
        for name in part["name"]:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                archive.writestr(name, name)
                archive.writestr(f"{name}.copy", name)
            contents.append(out.getvalue())
        yield pd.DataFrame({"path": "/x/" + part["name"] + ".zip", "content": contents})


@query("SELECT '/x/' || s_name || '.zip' AS path, s_name AS member, CAST(0 AS INTEGER) AS n FROM supplier UNION ALL SELECT '/x/' || s_name || '.zip', s_name || '.copy', 1 FROM supplier")
def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    """Members of archives, in their order."""
    names = t.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return files.members_of(names.mapInPandas(_zipped, "path string, content binary")).select("path", "member", "n")


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def html_report(spark: SparkSession, d: str) -> DataFrame:
    """A report over market segments, a few rows, holds a line for each of them."""
    segments = t.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"))
    rows = segments.collect()  # one row a segment
    page = stores.html_report([r.asDict() for r in rows])
    found = [tuple(r) for r in rows if all(f"<td>{x}</td>" in page for x in r)]
    return spark.createDataFrame(found, "segment string, n long, nations long")


@query("SELECT line, CAST(n AS BIGINT) AS n FROM (SELECT c_mktsegment || ': ' || count(*) AS line, 2 AS n FROM customer GROUP BY c_mktsegment)")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a report, written and added again."""
    path = _folder(spark)
    parts = t.table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("k")).select("c_mktsegment", F.concat("c_mktsegment", F.lit(": "), F.col("k").cast("string")).alias("text"))
    stores.report(parts, path, ["c_mktsegment"])
    stores.report(parts, path, ["c_mktsegment"], append=True)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _streamed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a query over the stream of events gives once all there is has been read."""
    out, state = _folder(spark), _folder(spark)
    given, source_at = t.table(spark, d, "events"), _folder(spark)
    given.write.parquet(source_at)  # a stream reads a folder, to which files are added
    source = spark.readStream.schema(given.schema).parquet(source_at)
    stream = pulses.with_event_time(source.select(F.col("user_id").alias("task_id"), "ts", F.col("value").alias("cpu"), F.col("event_id").alias("mem")), late="100 years")
    made = make(stream)
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@query("SELECT user_id AS task_id, 'cpu' AS what, value FROM events WHERE value > 90 UNION ALL SELECT user_id, 'mem', CAST(event_id AS DOUBLE) FROM events WHERE event_id > 100")
def stream_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Samples over a limit, from a stream."""
    return _streamed(spark, d, lambda s: pulses.alarms(s, 90.0, 100)).select("task_id", "what", "value")


@query("SELECT user_id AS task_id FROM events GROUP BY 1 HAVING epoch_us(max(ts)) - epoch_us(min(ts)) > 1000000 * CAST(86400 AS BIGINT)")
def stream_overdue(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that run for over a day, from a stream."""
    return _streamed(spark, d, lambda s: pulses.overdue(s, 86400.0)).select("task_id")
