"""Files as tables: catalogues, lines, archives, notebooks, pulses.  Spark's readers do the reading."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import patterns

PULSE_SCHEMA = "ts double, cpu double, mem long, nproc int, child_cpu double, child_mem long"


def catalogue(spark: SparkSession, root: str, glob: str | None = None, hashes: bool = False) -> DataFrame:
    """(path, name, size, mtime[, md5]) of all files under ``root``; content is only read for hashes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    columns = [path.alias("path"), F.regexp_extract(path, "[^/]*$", 0).alias("name"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1_000_000).alias("mtime")]
    return found.select(*columns, *([F.md5("content").alias("md5")] if hashes else []))


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose path has the form of a name pattern; each wildcard is a column, and replaces one of its name."""
    found = patterns.extract(F.col("path"), pattern)
    out = files.select(*(c for c in files.columns if c not in found), *(c.alias(n) for n, c in found.items()))
    for n in found:
        out = out.where(F.col(n).isNotNull())
    return out


def visible(path: Column, root: str) -> Column:
    """Not hidden, nor directly under ``root``: what maintenance may touch."""
    inside = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    return path.startswith(root.rstrip("/") + "/") & inside.contains("/") & ~F.concat(F.lit("/"), inside).contains("/.")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, text): the lines of text files, compressed ones too, with their number in the file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\r?\\n$", "").alias("v"))
    return whole.select("file", F.posexplode(F.split("v", "\\r?\\n")).alias("n", "text"))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with a header; the types are inferred unless given."""
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def archive_members(spark: SparkSession, root: str) -> DataFrame:
    """(path, n, member): the members of zip and tar archives; of tar only files."""
    return members_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))


def members_of(archives: DataFrame) -> DataFrame:
    """(path, n, member) of archives (path, content), by the ends of their paths."""
    found = archives.where(F.lower("path").rlike(r"\.(zip|tar|tar\.gz|tgz)$")).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                if path.lower().endswith(".zip"):
                    names = zipfile.ZipFile(io.BytesIO(content)).namelist()
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        names = [m.name for m in tar if m.isfile()]
                rows += [(path, i, name) for i, name in enumerate(names)]
            yield pd.DataFrame(rows, columns=["path", "n", "member"])

    return found.mapInPandas(run, "path string, n int, member string")


def notebook_cells(spark: SparkSession, path: str, kernel: str | None = None) -> DataFrame:
    """(file, ord, cell_type, kernel, source) of notebooks' code cells, of one kernel if it is named."""
    schema = "array<struct<cells:array<struct<cell_type:string,metadata:struct<kernel:string>,source:string>>>>"
    # Read as text: where sources are lists, the reader of JSON files was seen to read many times what a file holds.
    text = F.regexp_replace("value", "^\ufeff", "")
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json(text, schema)).alias("book"))
    cells = read.select("file", F.posexplode("book.cells").alias("ord", "c")).select("file", "ord", "c.cell_type", F.col("c.metadata.kernel").alias("kernel"), source_text(F.col("c.source")).alias("source"))
    code = cells.where("cell_type = 'code'")
    return code if kernel is None else code.where(F.coalesce("kernel", F.lit(kernel)) == kernel)


def source_text(source: Column) -> Column:
    """A cell's source, which is a text or a list of lines, as text."""
    return F.when(source.startswith("["), F.array_join(F.from_json(source, "array<string>"), "")).otherwise(source)


def pulses(spark: SparkSession, path: str) -> DataFrame:
    """Samples of task monitors: tab-separated, lines from # on are comments; the task is the file's name."""
    read = spark.read.schema(PULSE_SCHEMA).option("sep", "\t").option("comment", "#").csv(path)
    return read.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("task_id"), F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")).alias("ts"), "cpu", "mem", "nproc", "child_cpu", "child_mem")


def workflow_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, key, value) of ``#time<TAB>key<TAB>value`` lines of workflow pulses."""
    read = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("value").startswith("#"))
    parts = F.split(F.substring("value", 2, 1 << 30), "\t", 3)
    return read.select("file", F.get(parts, F.lit(0)).try_cast("double").alias("ts"), F.get(parts, F.lit(1)).alias("key"), F.get(parts, F.lit(2)).alias("value")).where(F.col("ts").isNotNull())


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, seq, qual): reads of four lines each."""
    numbered = lines(spark, path).withColumn("read", F.floor(F.col("n") / 4)).withColumn("k", F.col("n") % 4)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("text")))
    return numbered.groupBy("file", "read").agg(pick(0).alias("id"), pick(1).alias("seq"), pick(3).alias("qual")).select("file", F.substring("id", 2, 1 << 30).alias("id"), "seq", "qual")
