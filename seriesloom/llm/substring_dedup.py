"""Removal of repeated passages of words with an FM-index per shard.

Texts are cut into runs of windows that are routed by content (``runs``), so that equal windows meet
in one shard. A shard builds a compressed FM-index (a packed wavelet matrix over the transformed
text) of its different runs and streams the runs through it: backward search gives the matching
statistics at every window's end, and where they reach the window's length the interval of rows
tells which windows are equal. All but the first of those are reported.

Defined cases: words are split at ASCII white space and kept as they are; a null text has no words;
a text shorter than a window loses nothing; equal ids, copies and order as in ``runs``; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seriesloom.llm import runs
from seriesloom.llm.fmindex import FMIndex

WINDOW, GRAM, SHARD = 20, 6, 4 << 20


SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
BYTES = runs.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
PLACES = runs.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, each the sum of its bytes' numbers times those of their places."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + runs.BLOCK)))
        at, here = start[i], start[i:j] - start[i]
        part = data[at : end[j - 1]]
        place = np.arange(len(part)) - np.repeat(here, np.diff(np.append(here, len(part))))
        value = BYTES[part] * PLACES[place & 255]
        value[part == 32] = 0
        out[i:j] = np.add.reduceat(value, here)
        i = j
    return runs.mixed(out)


def word_units():
    def make(blob: bytes):
        blob = blob.translate(SPACES)
        data = np.frombuffer(blob, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], data != 32, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        before = np.concatenate([[0], np.cumsum(end - start)])

        def pieces(i: np.ndarray, j: np.ndarray) -> list[bytes]:
            a, b = start[i], end[j - 1]
            plain = b - a == before[j] - before[i] + (j - i - 1)  # a space between any two words
            return [blob[x:y] if p else b" ".join(blob[x:y].split()) for x, y, p in zip(a.tolist(), b.tolist(), plain.tolist(), strict=True)]

        return word_hashes(data, start, end), pieces, lambda at: np.searchsorted(start, at)

    return make


def solve(shard: runs.Shard, k: int) -> Iterator[tuple[bytes, int, int]]:
    names: dict[bytes, int] = {}
    numbers, ends, run, window = [0], [], [], []
    for r, (units, count) in enumerate(zip(shard.units, shard.windows, strict=True)):
        words = units.split()
        first = len(numbers)
        numbers.extend([names.setdefault(w, len(names) + 1) for w in words])
        numbers.append(0)
        ends.append(np.arange(first + k - 1, first + k - 1 + count))
        run.append(np.full(count, r))
        window.append(np.arange(count))
    text = np.array(numbers, np.int64)
    index = FMIndex(text, k + 1)
    length, row = index.matching(text, np.concatenate(ends), k)
    above = length >= k
    yield from shard.later(np.concatenate(run)[above], np.concatenate(window)[above], row[above], k)


def _find(batches: Iterator[pa.RecordBatch], k: int, most: int) -> Iterator[pa.RecordBatch]:
    return runs.sharded(batches, partial(solve, k=k), most)


def _cut(doc_id: int | None, data: bytes, spans: list[tuple[int, int]] | None, k: int) -> dict:
    words = data.split()
    if spans is None:
        spans = [(0, len(words))] if len(words) >= k else []
    kept, done = [], 0
    for start, end in spans:
        kept += words[done:start]
        done = end
    kept += words[done:]
    return {
        "doc_id": doc_id,
        "n_words": len(words),
        "n_removed": len(words) - len(kept),
        "kept": b" ".join(kept).decode("utf-8", "surrogatepass"),
    }


def deduplicate(docs: DataFrame, k: int = WINDOW, m: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every row. Runs jobs."""
    first, merged = runs.hits(docs, word_units, partial(_find, k=k, most=shard), k, m)
    return runs.digest(docs, first, merged, partial(_cut, k=k), "doc_id long, n_words long, n_removed long, kept string")
