"""Snapshots of JSON feeds that were landed in a directory, one small document per file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.clean import to_number, to_time

# Columns of the three feeds.
PLASMA = ("density", "speed", "temperature")
MAG = ("bx_gsm", "by_gsm", "bz_gsm", "lon_gsm", "lat_gsm", "bt")
KP = ("time_tag", "Kp", "a_running", "station_count")


UNREADABLE = "file is not the expected JSON: "


def _documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _tables(spark.read.text(path, wholetext=True))


def _tables(text: DataFrame) -> DataFrame:
    table = F.from_json("value", "array<array<string>>")
    return text.select(F.col("_metadata.file_path").alias("source_file"), table.alias("_t"))


def stream_files(
    spark: SparkSession, path: str, pattern: str = "*.json", files_per_batch: int | None = None
) -> DataFrame:
    """A stream of whole text files, one row ``value`` each, in the order they land."""
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path, wholetext=True)


def stream_header_json(
    files: DataFrame, columns: Sequence[str], time_col: str = "time_tag", strict_time: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a stream of header-array files; rejects are ``source_file``s.

    The two are streams of their own and need a query each.
    """
    docs = _tables(files)
    rows = _header_rows(docs.where("_t is not null"), columns, time_col, strict_time, False)
    return rows, docs.where("_t is null").select("source_file")


def stream_object_json(
    files: DataFrame, fields: Sequence[str] = KP, wrapper: str = "data"
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a stream of files with an array of objects, wrapped or bare.

    All fields are text, as in ``read_object_json``.
    """
    item = "array<struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">>"
    inside = F.from_json("value", f"struct<`{wrapper}`: {item}>")[wrapper]
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", item))
    docs = files.select(F.col("_metadata.file_path").alias("source_file"), F.coalesce(inside, bare).alias("_i"))
    rows = docs.where("_i is not null").select(F.explode("_i").alias("_i")).select("_i.*")
    return rows, docs.where("_i is null").select("source_file")


def unreadable_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``source_file`` of the files whose text is not an array of arrays, such as a cut download."""
    return _documents(spark, path).where("_t is null").select("source_file")


def _readable(docs: DataFrame, skip_unreadable: bool) -> DataFrame:
    if skip_unreadable:
        return docs.where("_t is not null")
    failed = F.raise_error(F.concat(F.lit(UNREADABLE), F.col("source_file"))).cast("array<array<string>>")
    return docs.withColumn("_t", F.coalesce("_t", failed))


def header_of(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Column names of all files' first rows, in the order of the file names. Runs a job.

    Files with the same header count once, so what is collected grows with the number of
    different headers only. An unreadable file fails.
    """
    docs = _readable(_documents(spark, path), False).where(F.size("_t") >= 1)
    seen = docs.groupBy(F.col("_t")[0].alias("h")).agg(F.min("source_file").alias("f")).collect()
    return list(dict.fromkeys(c for r in sorted(seen, key=lambda r: r.f) for c in r.h))


def read_header_json(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    time_col: str = "time_tag",
    strict_time: bool = False,
    drop_all_null: bool = False,
    positions: bool = False,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Files of the form ``[[header], [row], ...]``.

    Columns are found by name in each file's own header, so their order may differ between
    files; an absent one is NULL. Values that are not numbers are NULL. Files without data
    rows give none. A file that does not parse fails the job unless ``skip_unreadable``, with
    ``unreadable_files`` to list what was left out. ``positions`` keeps ``source_file`` and
    ``source_pos``.
    """
    docs = _readable(_documents(spark, path), skip_unreadable)
    out = _header_rows(docs, columns, time_col, strict_time, positions)
    return out.na.drop("all", subset=list(columns)) if drop_all_null else out


def _header_rows(
    docs: DataFrame, columns: Sequence[str], time_col: str, strict_time: bool, positions: bool
) -> DataFrame:
    rows = docs.where(F.size("_t") >= 2).select(
        "source_file",
        F.col("_t")[0].alias("_header"),
        F.posexplode(F.slice("_t", 2, F.size("_t") - 1)).alias("source_pos", "_row"),
    )

    def field(name: str) -> Column:
        at = F.nullif(F.array_position("_header", name), F.lit(0).cast("long"))
        return F.try_element_at("_row", at.cast("int"))

    kept = ["source_file", "source_pos"] if positions else []
    return rows.select(
        to_time(field(time_col), strict_time).alias(time_col),
        *[to_number(field(c)).alias(c) for c in columns],
        *kept,
    )


def read_object_json(
    spark: SparkSession,
    path: str | Sequence[str],
    fields: Sequence[str] = KP,
    wrapper: str = "data",
) -> DataFrame:
    """Files with an array of objects, or with that array inside ``{"data": [...]}``.

    All fields are read as text, because feeds quote numbers or not as they please. A file
    that does not parse fails the job.
    """
    item = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    schema = T.StructType([*item.fields, T.StructField(wrapper, T.ArrayType(item))])
    raw = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    bare = F.array(F.struct(*fields))
    items = F.when(F.col(wrapper).isNotNull(), F.col(wrapper)).otherwise(bare)
    return raw.select(F.explode(items).alias("_i")).select("_i.*")


def typed_objects(raw: DataFrame, time_col: str, numbers: Mapping[str, str]) -> DataFrame:
    """Time and the given ``{field: new name}`` numbers; rows missing any of them are dropped."""
    out = raw.select(
        to_time(time_col).alias(time_col), *[to_number(f).alias(n) for f, n in numbers.items()]
    )
    return out.na.drop("any")
