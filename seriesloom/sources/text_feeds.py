"""Whitespace-separated text archives. Files are split like any text, fields are columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.config import ARCHIVE_SENTINELS
from seriesloom.functions.clean import nan_to_null, sentinel_to_null
from seriesloom.functions.timeaxis import day_of_year_time
from seriesloom.operators.clean import dedupe

# 0-based field numbers and types of the hourly archive.
ARCHIVE_FIELDS = {
    "year": (0, "int"),
    "day": (1, "int"),
    "hour": (2, "int"),
    "bt": (9, "double"),
    "by_gsm": (15, "double"),
    "bz_gsm": (16, "double"),
    "density": (23, "double"),
    "speed": (24, "double"),
    "kp_raw": (38, "double"),
}
ARCHIVE_MIN_FIELDS = 40
# The short form of the archive; -1 is the last field of a line.
SHORT_FIELDS = {
    "year": (0, "int"),
    "month": (1, "int"),
    "day": (2, "int"),
    "hour": (3, "int"),
    "speed": (6, "string"),
    "density": (7, "string"),
    "bt": (9, "string"),
    "bz_gsm": (10, "string"),
    "kp_raw": (-1, "string"),
}
SHORT_MIN_FIELDS = 11
SHORT_FILL_TEXT = {"speed": "99999.9", "density": "999.9", "bt": "999.9", "bz_gsm": "999.9", "kp_raw": "99"}
ARCHIVE_SKIP = ("Yr", "--")
# The monthly index file.
MONTHLY_FIELDS = {"year": (0, "int"), "month": (1, "int"), "ssn": (3, "double")}
MONTHLY_MIN_FIELDS = 4
MONTHLY_SKIP = ("#",)


def read_fixed_text(
    spark: SparkSession,
    path: str | Sequence[str],
    fields: Mapping[str, tuple[int, str]],
    min_fields: int,
    skip: Sequence[str] = (),
) -> DataFrame:
    """Pick fields by number. Blank lines, lines with a ``skip`` prefix, short lines and lines
    in which a picked field cannot be read are left out."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    lines = spark.read.text(path).select(
        line.alias("_line"), F.col("_metadata.file_path").alias("source_file")
    )
    wanted = F.col("_line") != ""
    for prefix in skip:
        wanted = wanted & ~F.col("_line").startswith(prefix)
    parts = lines.where(wanted).select("source_file", F.split("_line", " ").alias("_f"))
    parts = parts.where(F.size("_f") >= min_fields)

    def pick(at: int, kind: str) -> Column:
        text = F.element_at("_f", at + 1 if at >= 0 else at)
        return text if kind == "string" else text.try_cast(kind)

    out = parts.select(*[pick(*spec).alias(n) for n, spec in fields.items()], "source_file")
    readable = F.lit(True)
    for n in fields:
        readable = readable & F.col(n).isNotNull()
    return out.where(readable)


def read_hourly_archive(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Yearly files of hourly rows: ``time_tag, speed, density, by_gsm, bz_gsm, bt, kp``.

    Fill codes become NULL, rows with any NULL are dropped, and of rows with the same time
    the one from the last file is kept.
    """
    raw = read_fixed_text(spark, path, ARCHIVE_FIELDS, ARCHIVE_MIN_FIELDS, ARCHIVE_SKIP)
    values = {c: sentinel_to_null(c, codes) for c, codes in ARCHIVE_SENTINELS.items()}
    rows = raw.withColumns(values).select(
        day_of_year_time(F.col("year"), F.col("day"), F.col("hour")).alias("time_tag"),
        *[nan_to_null(c).alias(c) for c in ("speed", "density", "by_gsm", "bz_gsm", "bt")],
        nan_to_null(F.col("kp_raw") / 10.0).alias("kp"),
        "source_file",
    )
    return dedupe(rows.na.drop("any"), "time_tag", ["source_file"], "last").drop("source_file")


def read_short_archive(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The short form: calendar date, five fields, fill codes compared as text."""
    raw = read_fixed_text(spark, path, SHORT_FIELDS, SHORT_MIN_FIELDS, ARCHIVE_SKIP)
    time = F.try_make_timestamp_ntz(
        F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.lit(0), F.lit(0)
    )
    values = [
        F.when(F.col(c) != fill, F.col(c).try_cast("double")).alias(c)
        for c, fill in SHORT_FILL_TEXT.items()
    ]
    rows = raw.select(time.alias("time_tag"), *values)
    return rows.withColumn("kp", F.col("kp_raw") / 10.0).drop("kp_raw").na.drop("any")


def read_monthly_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Monthly index as ``time_tag`` (day 15) and ``ssn``; negative values are unpublished."""
    raw = read_fixed_text(spark, path, MONTHLY_FIELDS, MONTHLY_MIN_FIELDS, MONTHLY_SKIP)
    time = F.try_make_timestamp_ntz(
        F.col("year"), F.col("month"), F.lit(15), F.lit(0), F.lit(0), F.lit(0)
    )
    return raw.where(F.col("ssn") >= 0).select(time.alias("time_tag"), "ssn").na.drop("any")
