"""Sinks: append-only stores whose newest rows count, reports, graphs."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.provenance import latest


class AppendStore:
    """A table to which rows are only added; for each key the row of the greatest version counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: str):
        self.spark, self.path, self.key, self.version = spark, path, key, version

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        """All rows, as they were added."""
        return self.spark.read.parquet(self.path)

    def current(self) -> DataFrame:
        return latest(self.log(), self.key, self.version)

    def get(self, *keys: object) -> DataFrame:
        """The current rows of some keys; the keys are pushed down to the files."""
        return latest(self.log().where(F.col(self.key).isin(*keys)), self.key, self.version)

    def purge(self, keys: DataFrame, into: str) -> None:
        """Write what is left without some keys to another place."""
        self.log().join(keys.select(self.key).distinct(), self.key, "left_anti").write.parquet(into)


def report(parts: DataFrame, path: str, order: list[str], append: bool = False) -> None:
    """Lines (column text), in order, as text files; new, or added to what is there."""
    parts.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("append" if append else "overwrite").text(path)


def html_report(workflows: list[dict], title: str = "Runs") -> str:
    """A page over a bounded list of runs, such as ``merged_log`` and ``timeline`` give for a report."""
    keys = list(dict.fromkeys(k for w in workflows for k in w))
    cells = lambda tag, values: "".join(f"<{tag}>{escape(str(v))}</{tag}>" for v in values)
    rows = "".join(f"<tr>{cells('td', (w.get(k, '') for k in keys))}</tr>" for w in workflows)
    return f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body><table><tr>{cells('th', keys)}</tr>{rows}</table></body></html>"
