"""Routing of windows that may repeat, shared by the two operators that remove repeated passages.

A window is ``k`` consecutive units (words or bytes) of one text. Every window is given a key, the
smallest hash of its ``m``-unit grams, so equal windows have equal keys wherever they are.
Neighbouring windows mostly share a key; such a run of windows is one row. Keys that only one text
has, once, cannot hold a repeated window and end here; for the others the runs with their units go
to where their key is dealt to, once per different run. There an index finds each window that also
starts earlier. All that is known about copies of a whole text or of a whole run is their number and
the first place, so a group of copies costs one row per task that sees it, never pairs.

A key with more than ``most`` runs, those of one text counted one by one and long runs as several, is
not kept together: its windows travel one by one under their own hash, so that no task has to hold
them.

Order of documents: by id, a missing id first; among different texts with the same id by the hash of
the text; rows with the same id and text are one document and get the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import Out, rows
from seriesloom.session import written

MOST = 200_000
BLOCK = 1 << 20  # windows; a place in a block has 21 bits
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


_STEPS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(units: np.ndarray, m: int) -> np.ndarray:
    """Hash of every ``m`` consecutive units (64-bit hashes themselves), by doubling."""
    made, size, level = units, 1, 0
    n = len(units) - m + 1
    out, at, left = None, 0, m
    while True:
        if left & 1:
            part = made[at : at + n]
            out = part if out is None else out * _STEPS[32 + level] + part
            at += size
        left >>= 1
        if not left:
            return mixed(out)
        made = made[:-size] * _STEPS[level] + made[size:]
        size, level = size * 2, level + 1


def runs_of(units: np.ndarray, k: int, m: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows, several) of the runs of texts behind each other.

    Text ``d`` has the units from ``low[d]`` to ``high[d]``; without them all units are one text.
    ``several``: the place of the key's gram moves inside the run; else no two of its windows are equal.
    The key is the gram at the leftmost least place, so equal windows have it at equal distance.
    """
    windows, tail = len(units) - k + 1, np.uint64((1 << 21) - 1)
    low, high = (np.zeros(1, np.int64), np.array([len(units)])) if low is None else (low, high)
    long = high - low >= k
    low, high = low[long], high[long]
    if not len(low):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    step = np.zeros(windows + 1, np.int8)
    step[low] += 1
    step[high - k + 1] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    opens = np.zeros(windows, bool)
    opens[low] = True
    keys, firsts, counts, moves = [], [], [], []
    for at in range(0, windows, BLOCK):
        end = min(at + BLOCK, windows)
        grams = gram_hashes(units[at : end + k - 1], m)
        place = (sliding_min(grams & ~tail | np.arange(len(grams), dtype=np.uint64), k - m + 1) & tail).astype(np.int64)
        key = grams[place]
        head = opens[at:end].copy()
        head[0] = True
        head[1:] |= key[1:] != key[:-1]
        moved = np.concatenate([[False], place[1:] != place[:-1]]) & ~head
        take = np.flatnonzero(inside[at:end])
        if not len(take):
            continue
        head = head[take]
        head[0] = True
        first = np.flatnonzero(head)
        keys.append(key[take[first]])
        firsts.append(take[first] + at)
        counts.append(np.diff(np.append(first, len(take))))
        moves.append(np.add.reduceat(moved[take], first) > 0)
    return np.concatenate(keys).view(np.int64), np.concatenate(firsts), np.concatenate(counts), np.concatenate(moves)


CHUNK = 1 << 17  # bytes of texts that are cut into runs together; a longer text is a chunk of its own
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks(texts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows that begin with a text's bytes, in lists of about ``CHUNK`` bytes."""
    held, size = [], 0
    for row in texts:
        if held and size + len(row[0]) > CHUNK:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[0])
    if held:
        yield held


def runs_in(texts: list[bytes], make: Callable, k: int, m: int) -> tuple:
    """Runs of texts: their text's number, key, first unit, windows, several; first units, and the slicer."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    hashed, pieces, number = make(b" ".join(texts))
    low, high = number(begin), number(begin + size)
    key, first, count, several = runs_of(hashed, k, m, low, high)
    return np.searchsorted(low, first, "right") - 1, key, first, count, several, low, pieces


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def half_of(tk: bytes) -> int:
    return int.from_bytes(tk[:8], "little", signed=True)


def _keys(batches: Iterator[pa.RecordBatch], units: Callable, k: int, m: int) -> Iterator[pa.RecordBatch]:
    """A row per key of a text: half of the text's name, the key, whether it could repeat a window in the text.

    ``load``: the number of its runs there, or their units in usual runs if that is more. A task
    shows a text once.
    """
    make = units()
    shown: set[int] = set()

    def new() -> Iterator[tuple]:
        for batch in batches:
            for (text,) in rows(batch, "text"):
                data = _data(text)
                half = half_of(xxhash.xxh3_128_digest(data))
                if half not in shown:
                    if len(shown) > 500_000:
                        shown.clear()
                    shown.add(half)
                    yield data, half

    for held in chunks(new()):
        doc, key, _, count, several, _, _ = runs_in([d for d, _ in held], make, k, m)
        if not len(key):
            continue
        order = np.lexsort((key, doc))
        doc, key, count, several = doc[order], key[order], count[order], several[order]
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(head, len(key)))
        size = np.add.reduceat(count + (k - 1), head)
        load = np.maximum(n, -(-size // (2 * k - m)))  # a run whose gram stays has 2k - m units at most
        half = np.array([h for _, h in held], np.int64)[doc[head]]
        more = (n > 1) | (np.add.reduceat(several, head) > 0)
        for i in range(0, len(head), 65_536):
            part = slice(i, i + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (half, key[head], more, load)], ["half", "key", "more", "load"])


OCCURRENCES = "key long, ch binary, sid long, tk binary, start long, windows long, several boolean, units binary"
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
_OCCURRENCES = pa.schema([(c.split()[0], t) for c, t in zip(OCCURRENCES.split(", "), _KINDS, strict=True)])


def _pairs(lists: list[np.ndarray]) -> np.ndarray:
    """(number of the list, key) as one number; should two pairs share it, more runs are looked at."""
    doc = np.repeat(np.arange(len(lists), dtype=np.uint64), [len(x) for x in lists])
    return np.concatenate(lists).view(np.uint64) + doc * _ODD


def _occurrences(batches: Iterator[pa.RecordBatch], units: Callable, k: int, m: int) -> Iterator[pa.RecordBatch]:
    """Runs whose key is asked for; a task shows the units of a run once."""
    make = units()
    shown: set[bytes] = set()

    def wanted() -> Iterator[tuple]:
        for batch in batches:
            lists = [(batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("asked", "hot")]
            for i, (sid, tk, text) in enumerate(rows(batch, "sid", "tk", "text")):
                data = _data(text)
                if xxhash.xxh3_128_digest(data) == tk:
                    yield data, sid, tk, *[values[at[i] : at[i + 1]] for values, at in lists]

    def made(held: list[tuple], pieces: Callable, low: np.ndarray, doc, key, first, count, several) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(doc), 4096):
            d, at, n = doc[i : i + 4096], first[i : i + 4096], count[i : i + 4096]
            contents = pieces(at, at + n + (k - 1))
            names = [xxhash.xxh3_128_digest(c) for c in contents]
            if len(shown) > 500_000:
                shown.clear()
            for j, name in enumerate(names):
                if name in shown:
                    contents[j] = None
                else:
                    shown.add(name)
            own = key[i : i + 4096] if key is not None else np.array([half_of(name) for name in names], np.int64)
            of = d.tolist()
            columns = [own, names, [held[x][1] for x in of], [held[x][2] for x in of], at - low[d], n, several[i : i + 4096], contents]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], schema=_OCCURRENCES)

    for held in chunks(wanted()):
        doc, key, first, count, several, low, pieces = runs_in([h[0] for h in held], make, k, m)
        pair = key.view(np.uint64) + doc.astype(np.uint64) * _ODD
        take = np.isin(pair, _pairs([h[3] for h in held]))
        alone = take & np.isin(pair, _pairs([h[4] for h in held]))
        take &= ~alone
        yield from made(held, pieces, low, doc[take], key[take], first[take], count[take], several[take])
        if alone.any():
            n = count[alone]
            at = np.repeat(first[alone] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            one = np.ones(len(at), np.int64)
            yield from made(held, pieces, low, np.repeat(doc[alone], n), None, at, one, one < 1)


def hits(docs: DataFrame, units: Callable, find: Callable, k: int, m: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(first, covered): the first document of every text (tk, first), and for those documents the
    sorted, disjoint ranges of units that earlier windows cover (tk, ranges).

    ``units`` makes a function from bytes to the units' hashes, a function that gives the bytes
    between units, and one that gives the first unit at or behind a byte;
    ``find`` reads rows (key, ch, sid, tk, start, windows, units) sorted by key and yields
    (tk, start, end) for windows that start earlier. Runs jobs.
    """
    smallest = -(1 << 63)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(smallest)).alias("sid"), "text")
    # Half of a text's name is enough here: should two texts share it, both are asked for more.
    each = plain.mapInArrow(partial(_keys, units=units, k=k, m=m), "half long, key long, more boolean, load long")
    # one shuffle of the keys; a group of one key is streamed from disk beyond a bound
    same = Window.partitionBy("key")
    again = F.max("more").over(same) | (F.min("half").over(same) != F.max("half").over(same))
    repeated = each.select("half", "key", again.alias("again"), (F.sum("load").over(same) > most).alias("is_hot"))
    asked = (
        repeated.where("again")
        .groupBy("half")
        .agg(F.collect_set("key").alias("asked"), F.collect_set(F.when(F.col("is_hot"), F.col("key"))).alias("hot"))
    )
    # ids may repeat or be missing, so a text is found again by its id and its own hash
    plain = plain.withColumn("own", F.xxhash64("text"))
    hashed = plain.mapInArrow(_text_hash, "sid long, own long, tk binary, half long")
    least = hashed.groupBy("tk").agg(F.min(F.struct("sid", "own", "half")).alias("least"))
    first = written(least.select("tk", F.col("least.sid").alias("first"), "least.own", "least.half"), "first")
    wanted = asked.join(first, "half").drop("half").withColumnRenamed("own", "like")
    wanted = written(wanted.withColumnRenamed("first", "want"), "asked")
    texts = plain.join(wanted, (plain["sid"] == wanted["want"]) & (plain["own"] == wanted["like"])).select("sid", "tk", "text", "asked", "hot")
    # a row per run, in the shared folder: what follows reads it twice
    seen = written(texts.mapInArrow(partial(_occurrences, units=units, k=k, m=m), OCCURRENCES), "runs")
    place = F.struct("sid", "tk", "start")
    distinct = seen.groupBy("key", "ch").agg(F.min(place).alias("at"), F.max("windows").alias("windows"), F.max("several").alias("several"), F.max("units").alias("units"))
    dealt = distinct.select("key", "at.sid", "at.tk", "at.start", "windows", "units", "several").repartition("key").sortWithinPartitions("key")
    inside = dealt.mapInArrow(find, "tk binary, start long, end long")
    heads = distinct.select("key", "ch", "at")
    later = (
        seen.select("key", "ch", "sid", "tk", "start", "windows")
        .join(heads, ["key", "ch"])
        .where(place != F.col("at"))
        .select("tk", "start", (F.col("start") + F.col("windows") + (k - 1)).alias("end"))
    )
    merged = (
        inside.union(later)
        .groupBy("tk")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    )
    # small, and its shuffles are gone before those of the texts come
    return first.select("tk", "first"), written(merged, "ranges")


def _text_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(pa.schema([("sid", pa.int64()), ("own", pa.int64()), ("tk", pa.binary()), ("half", pa.int64())]))
    for batch in batches:
        for sid, own, text in rows(batch, "sid", "own", "text"):
            tk = xxhash.xxh3_128_digest(_data(text))
            if out.add(sid, own, tk, half_of(tk)):
                yield out.take()
    yield from out.rest()


def digest(docs: DataFrame, first: DataFrame, merged: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """The rows that ``cut(doc_id, data, ranges)`` makes of every document and its covered ranges.

    ``ranges`` is None for a copy of an earlier document. One shuffle of the texts.
    """
    smallest = -(1 << 63)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(smallest)).alias("sid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = first.join(merged, "tk", "left")
    with_key = plain.mapInArrow(_with_key, "sid long, doc_id long, text string, tk binary")
    both = with_key.join(known, "tk").select("doc_id", "text", (F.col("sid") != F.col("first")).alias("copy"), F.coalesce("ranges", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("ranges"))
    return both.mapInArrow(partial(_cut, cut=cut), schema)


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [xxhash.xxh3_128_digest(_data(text)) for (text,) in rows(batch, "text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "tk"])


def _cut(batches: Iterator[pa.RecordBatch], cut: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for doc_id, text, copy, ranges in rows(batch, "doc_id", "text", "copy", "ranges"):
            spans = None if copy else union([(r["start"], r["end"]) for r in ranges or []])
            made.append(cut(doc_id, _data(text), spans))
        if made:
            yield pa.RecordBatch.from_pylist(made)


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in ranges:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Shard:
    """Different runs of some keys, collected until an index over them is worth building."""

    def __init__(self):
        self.sid, self.tk, self.start, self.windows, self.units = [], [], [], [], []

    def add(self, group: list[tuple]) -> int:
        for sid, tk, start, windows, units, _ in group:
            self.sid.append(sid), self.tk.append(tk), self.start.append(start), self.windows.append(windows), self.units.append(units)
        return sum(len(g[4]) for g in group)

    def places(self) -> np.ndarray:
        """Order of the runs' documents."""
        known = {d: i for i, d in enumerate(sorted(set(zip(self.sid, self.tk, strict=True))))}
        return np.array([known[d] for d in zip(self.sid, self.tk, strict=True)], np.int64)

    def later(self, run: np.ndarray, window: np.ndarray, same: np.ndarray, k: int) -> Iterator[tuple[bytes, int, int]]:
        """(tk, start, end) of the windows that aren't the first of those with the same number."""
        if not len(run):
            return
        at = np.array(self.start, np.int64)[run] + window
        place = self.places()[run]
        order = np.lexsort((at, place, same))
        run, at, place, same = run[order], at[order], place[order], same[order]
        head = np.concatenate([[True], same[1:] != same[:-1]])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        hit = (place != place[lead]) | (at != at[lead])
        run, at = run[hit], at[hit]
        order = np.lexsort((at, run))
        run, at = run[order], at[order]
        if not len(run):
            return
        cut = np.flatnonzero((run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(run)], strict=True):
            yield self.tk[run[i]], int(at[i]), int(at[j - 1]) + k


def sharded(batches: Iterator[pa.RecordBatch], solve: Callable[[Shard], Iterator[tuple[bytes, int, int]]], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, in shards of about ``most`` bytes; a key's only run mostly repeats nothing."""
    out = Out(pa.schema([("tk", pa.binary()), ("start", pa.int64()), ("end", pa.int64())]), most=32_768)
    shard, size, key, group = Shard(), 0, None, []

    def close() -> Iterator[pa.RecordBatch]:
        for row in solve(shard):
            if out.add(*row):
                yield out.take()

    for batch in batches:
        for key_, *row in rows(batch, "key", "sid", "tk", "start", "windows", "units", "several"):
            if key_ != key:
                if len(group) > 1 or group and group[0][-1]:
                    size += shard.add(group)
                    if size >= most:
                        yield from close()
                        shard, size = Shard(), 0
                key, group = key_, []
            group.append(row)
    if len(group) > 1 or group and group[0][-1]:
        shard.add(group)
    if shard.sid:
        yield from close()
    yield from out.rest()
