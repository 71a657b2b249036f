"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(value: str = "doc_id") -> Column:
    """The id as text; a missing id counts as the empty text."""
    return F.coalesce(F.col(value).cast("string"), F.lit(""))


def fold_of(value: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's text, modulo ``folds``."""
    return F.pmod(F.crc32(id_text(value).cast("binary")), F.lit(folds))


def fold_number(doc_id: int | None, folds: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def unused_prefix(df: DataFrame) -> str:
    """A prefix that no column has, for names that stand beside the input's own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Rows of a batch one by one, so that only one long text is a Python object at a time."""
    for cells in zip(*[batch.column(c) for c in columns], strict=True):
        yield tuple(cell.as_py() for cell in cells)


class Out:
    """Collects output rows and hands them on in batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 4096, most_bytes: int = 16 << 20):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.columns: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, *values, weight: int = 0) -> bool:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.bytes += weight
        return len(self.columns[0]) >= self.most or self.bytes >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)],
            schema=self.schema,
        )
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return made

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()
