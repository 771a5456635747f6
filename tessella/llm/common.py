"""Helpers shared by the operators: Arrow batches, folds, schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.shared import cut, cut_by, shared_folder

__all__ = ["cut", "cut_by", "extend", "free_name", "shared_folder", "slices", "split_bucket", "text_bytes", "without"]

#: Whole texts that a task works on at a time.  Spark bounds Arrow batches by
#: their bytes; what Python makes of them is bounded by this.
TEXTS_AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def split_bucket(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def extend(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` with the columns of a DDL string after its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def free_name(taken: list[str], base: str) -> str:
    """A column name that is not taken, whatever its case."""
    lowered = {c.lower() for c in taken}
    while base.lower() in lowered:
        base += "_"
    return base


def without(names: list[str], new: list[str]) -> list[str]:
    """``names`` less those that new columns replace, whatever their case."""
    lowered = {c.lower() for c in new}
    return [c for c in names if c.lower() not in lowered]


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()
