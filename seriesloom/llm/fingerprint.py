"""Document fingerprints from improbable features.

A feature is a window of 64 bytes. Its entropy, rounded to a thousandth of the largest, has a
frequency in the corpus; the rarer the value, the better the window's rank. In each run of 64
windows the best one (the leftmost on a tie) gets a vote, and windows with enough votes are the
features of the text. A text of fewer than 256 bytes, or one where no window has enough votes, is
covered instead: its features are the best windows of short stretches, chosen so that every byte
lies in one. Features are inserted in order into a chain of Bloom filters, the next one
starting when one is full. Two chains are compared filter by filter: the overlap of bits, less what
chance explains, over the largest overlap possible.

Frequencies are counted over all texts (one small histogram per task). Neighbours in id order meet
by dealing the rows out in ranges of ids; the first row of a range is also sent to the range before
it, so no task sees more than its range, sorted.

Defined cases: a null text counts as empty and has no feature; a text shorter than a window is one
feature; two texts without features are alike (1), one with and one without are not (0); equal
texts have equal fingerprints; equal ids are ordered by text, a missing id counts as the smallest;
a single row is its own neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Out, rows, sha256_hex

WIDTH, LEVELS, VOTES = 64, 1000, 16
SHORT = 4 * WIDTH  # texts below are covered by their features
WEAK = 100  # windows below a tenth of the largest entropy never rank
BITS, HASHES, FULL = 2048, 5, 160
BLOCK = 1 << 20
ROWS_IN_RANGE, MOST_RANGES = 500, 20_000

_c = np.arange(WIDTH + 1, dtype=np.float64)
_clog = np.where(_c > 0, _c * np.log2(np.maximum(_c, 1)), 0)
#: What the n-th equal byte of a window adds to the sum of c log c, in millionths.
STEP = np.concatenate([[0], np.rint(np.diff(_clog) * 1e6)]).astype(np.int64)
LARGEST = int(STEP.sum())


def entropies(data: np.ndarray) -> np.ndarray:
    """Level (0 to LEVELS) of the entropy of every window of ``data``."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (1 << 40) + order
    at = np.arange(n)
    # equal bytes among the WIDTH bytes that end, or start, at each position
    ending, starting = np.empty(n, np.int64), np.empty(n, np.int64)
    ending[order] = at - np.searchsorted(key, key - (WIDTH - 1)) + 1
    starting[order] = np.searchsorted(key, key + WIDTH) - at
    counts = np.bincount(data[:WIDTH], minlength=256)
    first = int(np.rint(_clog[counts] * 1e6).sum())
    change = STEP[ending[WIDTH:]] - STEP[starting[: n - WIDTH]]
    total = np.concatenate([[first], first + np.cumsum(change)])
    return np.clip((LARGEST - total) * LEVELS // LARGEST, 0, LEVELS)


def levels(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Levels of all windows in blocks that overlap by a window's reach: (first window, levels)."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(raw) - WIDTH + 1), BLOCK):
        yield at, entropies(raw[at : at + BLOCK + 2 * WIDTH])


def votes(ranks: np.ndarray) -> np.ndarray:
    """How many runs of WIDTH windows each window is the best of."""
    key = ranks.astype(np.int64) << 32 | np.arange(len(ranks))
    n = len(key)
    if n <= WIDTH:
        best = np.array([key.min()])
    else:
        best, span = key, 1
        while span < WIDTH:
            step = min(span, WIDTH - span)
            best = np.minimum(best[:-step], best[step:])
            span += step
    return np.bincount(best & 0xFFFFFFFF, minlength=n)


def covering(ranks: np.ndarray) -> list[int]:
    """Windows in which every byte lies: each the best (the last on a tie) of those half a window back."""
    last, chosen, at = len(ranks) - 1, [], 0
    while at < last + WIDTH:
        high = min(at, last)
        low = min(max(0, at - WIDTH // 2 + 1), high)
        chosen.append(high - int(ranks[low : high + 1][::-1].argmin()))
        at = chosen[-1] + WIDTH
    return chosen


def features(data: bytes, rank: np.ndarray) -> list[bytes]:
    """Digests of a text's features in order."""
    if not data:
        return []
    if len(data) < WIDTH:
        return [xxhash.xxh3_128_digest(data)]
    chosen: list[int] = []
    carried = np.empty(0, np.int64)
    for at, level in levels(data):
        last = at + BLOCK >= len(data) - WIDTH + 1
        # windows in the overlap get their votes from two blocks: those of runs that start in each
        if not last:
            own = votes_of_first(rank[level], BLOCK)
        elif at and len(level) < WIDTH:
            own = np.zeros(len(level), np.int64)
        else:
            own = votes(rank[level])
        own = own.astype(np.int64)
        own[: len(carried)] += carried[: len(own)]
        cut = len(own) if last else min(BLOCK, len(own))
        ok = (own[:cut] >= VOTES) & (rank[level[:cut]] < LEVELS + 1)
        chosen += (at + np.flatnonzero(ok)).tolist()
        carried = own[cut:]
    if not chosen or len(data) < SHORT:
        windows = len(data) - WIDTH + 1
        chosen = covering(np.concatenate([rank[level[: min(BLOCK, windows - at)]] for at, level in levels(data)]))
    return [xxhash.xxh3_128_digest(data[i : i + WIDTH]) for i in chosen]


def votes_of_first(ranks: np.ndarray, runs: int) -> np.ndarray:
    """Votes of the first ``runs`` runs only."""
    made = votes(ranks[: runs + WIDTH - 1])
    return np.concatenate([made, np.zeros(len(ranks) - len(made), made.dtype)])


def chain(found: list[bytes]) -> np.ndarray:
    """The Bloom filters of some features, packed, one per row."""
    n = -(-len(found) // FULL)
    bits = np.zeros((n, BITS), bool)
    if found:
        whole = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        which = np.arange(len(found)) // FULL
        for j in range(HASHES):
            bits[which, ((whole[:, 0] >> np.uint64(11 * j)) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how well the filters of the shorter chain are found in the longer one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if a.shape == b.shape and (a == b).all():
        return 1.0
    x, y = (np.ascontiguousarray(v).view(np.uint64) for v in (a, b))
    ex, ey = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    total = 0.0
    for i in range(len(x)):
        common = np.bitwise_count(x[i][None, :] & y).sum(1, dtype=np.int64)
        most = np.minimum(ex[i], ey)
        chance = ex[i] * ey / BITS
        score = (common - chance) / np.maximum(most - chance, 1e-9)
        # a filter with few bits is easily contained in a full one; that alone counts as much as its share
        score = score * np.minimum(1.0, np.maximum(ey, 1) / ex[i])
        total += float(np.clip(score, 0.0, 1.0).max()) * int(ex[i])
    return round(min(1.0, total / int(ex.sum())), 9)


def text_of(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        for (text,) in rows(batch, "text"):
            data = (text or "").encode("utf-8", "surrogatepass")
            if len(data) >= WIDTH:
                for at, level in levels(data):
                    total += np.bincount(level[: min(BLOCK, len(data) - WIDTH + 1 - at)], minlength=LEVELS + 1)
    yield pa.RecordBatch.from_pydict({"level": list(range(LEVELS + 1)), "n": total.tolist()})


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy level, the rarest in the corpus first; weak levels get the last rank."""
    made = docs.select("text").mapInArrow(_histogram, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(LEVELS + 1, np.int64)
    for r in made:  # LEVELS + 1 rows
        count[r.level] = r.n
    order = np.lexsort((-np.arange(LEVELS + 1), count))
    rank = np.empty(LEVELS + 1, np.int64)
    rank[order] = np.arange(LEVELS + 1)
    rank[:WEAK] = LEVELS + 1
    return rank


def _deal(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, heads: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Range of every row; the first rows of a range (largest id) also go to the range before it."""
    for batch in batches:
        sid = batch.column("sid").to_numpy(zero_copy_only=False)
        where = (len(bounds) - np.searchsorted(bounds, sid, "left")).astype(np.int64)
        copied = np.flatnonzero([heads.get(w) == s for w, s in zip(where.tolist(), sid.tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.zeros(len(sid), np.int64)), *batch.columns], ["range", "halo", *batch.schema.names])
        if len(copied):
            part = batch.take(pa.array(copied))
            order = sorted(heads)
            before = {w: order[i - 1] for i, w in enumerate(order)}  # the last range precedes the first
            yield pa.RecordBatch.from_arrays(
                [pa.array([before[w] for w in where[copied].tolist()]), pa.array(np.ones(len(copied), np.int64)), *part.columns],
                ["range", "halo", *batch.schema.names],
            )


MADE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprints(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out = Out(pa.schema([(c.split()[0], k) for c, k in zip(MADE.split(", "), kinds, strict=True)]), most_bytes=8 << 20)
    of = lambda text: chain(features(text.encode("utf-8", "surrogatepass"), rank))
    last, closed = None, None

    def emit(this: tuple, text: str, filters: np.ndarray) -> bool:
        _, doc_id, own, own_filters = this
        half = len(own) // 2
        edited = own[: len(own) - half] + text[:half]
        edited_filters = of(edited) if edited != own else own_filters
        a, b = text_of(own_filters), text_of(edited_filters)
        return out.add(
            doc_id,
            len(own),
            sha256_hex(edited.encode("utf-8", "surrogatepass")),
            a,
            b,
            likeness(own_filters, edited_filters),
            likeness(own_filters, filters),
            weight=len(a) + len(b),
        )

    for batch in batches:
        for range_, halo, doc_id, text in rows(batch, "range", "halo", "doc_id", "text"):
            if closed == range_:
                continue  # more rows with the id of the neighbour
            text = text or ""
            filters = of(text)
            if last is not None and last[0] == range_ and emit(last, text, filters):
                yield out.take()
            closed = range_ if halo else None
            last = None if halo else (range_, doc_id, text, filters)
    yield from out.rest()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness. Runs small jobs."""
    smallest = -(1 << 63)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(smallest)).alias("sid"), F.col("doc_id").cast("long"), "text")
    rank = rarity(docs)
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_IN_RANGE))
    cuts = keyed.agg(F.percentile_approx("sid", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first().c if ranges > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    heads_of = keyed.select("sid").mapInArrow(partial(_ranges, bounds=bounds), "range long, sid long")
    heads = {r.range: r.sid for r in heads_of.groupBy("range").agg(F.max("sid").alias("sid")).collect()}
    dealt = keyed.mapInArrow(partial(_deal, bounds=bounds, heads=heads), "range long, halo long, sid long, doc_id long, text string")
    sorted_ = dealt.repartition("range").sortWithinPartitions("range", "halo", F.desc("sid"), "text")
    return sorted_.mapInArrow(partial(_fingerprints, rank=rank), MADE)


def _ranges(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sid = batch.column("sid").to_numpy(zero_copy_only=False)
        where = (len(bounds) - np.searchsorted(bounds, sid, "left")).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(where), batch.column("sid")], ["range", "sid"])
