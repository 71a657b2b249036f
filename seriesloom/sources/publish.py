"""Stored results in versions, and markers that name the current one.

A version is a folder of its own and is never written again. A marker is a small file that is
written under another name and then moved into place by the file system's rename: readers find the
old version or the new one, whole in either case. Of two writers the later rename wins.

All through the file system that a path belongs to, on the driver; only markers and listings are read.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MARKER = "_current"


def _place(spark: SparkSession, path: str):
    """(JVM, path, file system) of a path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where it does not exist."""
    _, target, files = _place(spark, path)
    if not files.exists(target):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(target))


def set_marker(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of the one of that name, if there is one, in a single step."""
    jvm, target, files = _place(spark, path)
    made = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    if files.getUri().getScheme() == "file":
        folder, local = target.getParent().toUri().getPath(), made.toUri().getPath()
        os.makedirs(folder, exist_ok=True)
        with open(local, "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(local, target.toUri().getPath())
        return
    out = files.create(made)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    whole = files.makeQualified(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), files.getConf())
    context.rename(files.makeQualified(made), whole, options)


def marker(spark: SparkSession, path: str) -> str | None:
    """What a marker says; None where there is none."""
    jvm, target, files = _place(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, base: str, write: Callable[[str], None]) -> str:
    """Write a new version of what ``base`` names, then make it the current one.

    ``write`` gets the new folder's path; when it fails, the current version stays as it was.
    """
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    path = f"{base.rstrip('/')}/{name}"
    write(path)
    set_marker(spark, f"{base.rstrip('/')}/{MARKER}", name)
    return path


def current(spark: SparkSession, base: str) -> str | None:
    """The folder of the current version, if one has been published."""
    name = marker(spark, f"{base.rstrip('/')}/{MARKER}")
    return None if name is None else f"{base.rstrip('/')}/{name}"


def expire(spark: SparkSession, base: str, hours: float) -> list[str]:
    """Delete versions begun over ``hours`` ago that are not current; returns their names.

    The time has to be longer than any reader keeps a version open or any writer writes one.
    """
    keep, limit = marker(spark, f"{base.rstrip('/')}/{MARKER}"), time.time_ns() - int(hours * 3.6e12)
    old = [n for n in listed(spark, base) if n[:1].isdigit() and n != keep and int(n.split("-")[0]) < limit]
    for name in old:
        _, target, files = _place(spark, f"{base.rstrip('/')}/{name}")
        files.delete(target, True)
    return old
