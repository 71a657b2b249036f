"""Removal of repeated byte strings by external induced sorting per shard.

Texts are cut into runs of windows that are routed by content (``runs``), so that equal windows meet
in one shard. A shard's different runs, behind each other with separators, are sorted by induced
sorting that carries common prefixes (``suffix_sort``); neighbours in suffix order that share a whole
window are equal windows, and all but the first of them are reported.

Defined cases: texts are UTF-8 bytes; a null text counts as empty; a text shorter than a window
loses nothing; equal ids, copies and order as in ``runs``; an empty table gives no rows; other
columns are ignored. A removed run may cut a character in two, so kept bytes are binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm import runs
from seriesloom.llm.suffix_sort import suffixes

WINDOW, GRAM, SHARD = 100, 32, 2 << 20
TABLE = runs.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_units():
    def make(blob: bytes):
        pieces = lambda i, j: [blob[x:y] for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        return TABLE[np.frombuffer(blob, np.uint8)], pieces, lambda at: at

    return make


def solve(shard: runs.Shard, k: int) -> Iterator[tuple[bytes, int, int]]:
    # 0 ends the string, 1 separates runs, bytes follow
    parts, starts, at = [], [], 0
    for units in shard.units:
        parts += [np.frombuffer(units, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64)]
        starts.append(at)
        at += len(units) + 1
    text = np.concatenate([*parts, np.zeros(1, np.int64)])
    position, common = suffixes(text, k)
    first = np.array(starts, np.int64)
    run = np.searchsorted(first, position, "right") - 1
    window = position - first[run]
    whole = window < np.array(shard.windows, np.int64)[run]
    same = np.cumsum(common < k)
    # only strings that come more than once
    alike = (common >= k) | np.append(common[1:] >= k, False)
    take = whole & alike
    yield from shard.later(run[take], window[take], same[take], k)


def _find(batches: Iterator[pa.RecordBatch], k: int, most: int) -> Iterator[pa.RecordBatch]:
    return runs.sharded(batches, partial(solve, k=k), most)


def _cut(doc_id: int | None, data: bytes, spans: list[tuple[int, int]] | None, k: int) -> dict:
    if spans is None:
        spans = [(0, len(data))] if len(data) >= k else []
    kept, done = [], 0
    for start, end in spans:
        kept.append(data[done:start])
        done = end
    kept.append(data[done:])
    left = b"".join(kept)
    return {"doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data) - len(left), "n_spans": len(spans), "kept": left}


def deduplicate(docs: DataFrame, k: int = WINDOW, m: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row. Runs jobs."""
    first, merged = runs.hits(docs, byte_units, partial(_find, k=k, most=shard), k, m)
    return runs.digest(docs, first, merged, partial(_cut, k=k), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
