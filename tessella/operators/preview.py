"""Tabular previews: limited tables, series by group, previews of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.ordinal import with_ordinal

#: Rows of a table and of a scatter plot, lines of a text, that are shown by default.
TABLE_ROWS, SCATTER_ROWS, TEXT_LINES = 200, 2000, 5


def table(rows: DataFrame, order: list[str], limit: int = TABLE_ROWS) -> DataFrame:
    """The first rows; all if ``limit`` is negative."""
    return rows if limit < 0 else rows.orderBy(*order).limit(limit)


def numeric_columns(rows: DataFrame) -> list[str]:
    """Columns that sort as numbers."""
    return [f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def series(rows: DataFrame, x: str | None, ys: list[str], by: list[str], order: list[str], limit: int = SCATTER_ROWS) -> DataFrame:
    """(series, x, y): one series for each y and each occurring combination of ``by``; without x, the row number."""
    shown = table(rows, order, limit)
    placed = with_ordinal(shown, *order, name="_row")
    at = F.col("_row").cast("double") if x is None else F.col(x).cast("double")
    name = lambda y: F.concat_ws("|", F.lit(y), *(F.concat(F.lit(b + "="), F.coalesce(F.col(b).cast("string"), F.lit("null"))) for b in by))
    points = F.array(*(F.struct(name(y).alias("series"), at.alias("x"), F.col(y).cast("double").alias("y")) for y in ys))
    return placed.select(F.explode(points).alias("p")).select("p.*")


def head_lines(lines: DataFrame, file: str = "file", n: str = "n", text: str = "text", limit: int = TEXT_LINES) -> DataFrame:
    """(file, n_lines, n, text): the first lines of each file; all if ``limit`` is negative."""
    counts = lines.groupBy(file).agg(F.count("*").alias("n_lines"))
    shown = lines if limit < 0 else lines.where(F.col(n) < limit)
    return shown.join(counts, file).select(file, "n_lines", n, text)
