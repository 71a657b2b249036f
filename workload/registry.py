"""Registration of queries and the helpers that make their numbers comparable."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    """A derived series in SQL, put in front of every query whose text names it."""
    VIEWS[name] = body.strip()


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in needed) + "\n" + sql.strip()


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` with its SQL, if it has one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register


# Both engines add doubles in any order, so sums differ in the last bits, and their round()
# functions treat halves differently. Rounding is spelt out with the half moved off the values
# that short decimals can take.
HALF = "0.500001e0"


def r(value: Column | str, digits: int = 4) -> Column:
    scale = F.lit(10.0**digits)
    c = F.col(value) if isinstance(value, str) else value
    return F.floor(c * scale + F.lit(0.500001)) / scale


def R(expr: str, digits: int = 4) -> str:
    return f"(floor(({expr})*1e{digits} + {HALF})/1e{digits})"


def n(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")
