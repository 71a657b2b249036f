"""Join of documents by the Jaccard similarity of their word n-grams, with MinHash banding.

Documents with equal n-gram sets form a class; one of them stands for all, so copies are never
expanded into pairs. Signatures are cut into bands whose number and width follow from the wanted
recall at the threshold. Classes that share a band's hash are hung on the smallest of them, and the
connected components of that star graph hold every candidate pair. Inside a component all pairs are
verified on the full sets, as products of sparse-made-dense blocks, so that a pair costs arithmetic
and no row. A component of any size is cut into blocks; every pair of blocks is one group.

Words are lower-cased and split at ASCII white space. Defined cases: a text of fewer than five
words is one n-gram, a text without words (or null) has the empty set and is a copy of the other
such texts; ids may repeat or be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import Out, rows, unused_prefix
from seriesloom.llm.components import components
from seriesloom.session import written

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, Fraction(4, 5), 0.9999, 300
#: Sets and n-grams of a block of a component that is cut.
BLOCK_SETS, BLOCK_GRAMS = 1000, 1_500_000
SEED = 7


def bands_for(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the widest bands that find a pair at the threshold with the wanted recall."""
    best = None
    for width in range(1, most + 1):
        count = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**width)))
        if count * width <= most:
            best = (max(1, count), width)
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


class Grams:
    """Hashes of word n-grams; a word's hash is remembered."""

    def __init__(self, n: int, most: int = 500_000):
        self.n, self.most, self.known = n, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct n-gram hashes."""
        found = (text or "").lower().encode("utf-8", "surrogatepass").split()
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = min(self.n, len(h))
        made = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            made = (made ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            made ^= made >> np.uint64(29)
        return np.unique(made)


def class_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


class Signer:
    def __init__(self, bands: int, width: int):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.bands, self.width = bands, width
        self.a = rng.integers(0, 1 << 31, (bands * width, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (bands * width, 1), np.uint32)
        self.mix = rng.integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash per band."""
        x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
        least = np.full(self.bands * self.width, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(least, (x[None, at : at + 1024] * self.a + self.b).min(1), out=least)
        part = (least.astype(np.uint64).reshape(self.bands, self.width) + np.uint64(1)) * self.mix
        made = (part ^ (part >> np.uint64(31))).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)
        made = (made ^ (made >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (made ^ (made >> np.uint64(32))).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], n: int, bands: int, width: int) -> Iterator[pa.RecordBatch]:
    grams, sign = Grams(n), Signer(bands, width)
    kinds = [("doc_id", pa.int64()), ("own", pa.int64()), ("cls", pa.binary()), ("grams", pa.int64()), ("bands", pa.list_(pa.int64()))]
    out = Out(pa.schema(kinds))
    for batch in batches:
        for doc_id, own, text in rows(batch, "doc_id", "own", "text"):
            found = grams(text)
            if out.add(doc_id, own, class_of(found), len(found), sign(found).tolist() if len(found) else []):
                yield out.take()
    yield from out.rest()


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    grams = Grams(n)
    out = Out(pa.schema([("cls", pa.binary()), ("root", pa.int64()), ("blocks", pa.int64()), ("docs", pa.int64()), ("grams", pa.binary())]))
    for batch in batches:
        for text, cls, root, blocks, docs in rows(batch, "text", "cls", "root", "blocks", "docs"):
            found = grams(text)
            if class_of(found) == cls and out.add(cls, root, blocks, docs, found.tobytes(), weight=8 * len(found)):
                yield out.take()
    yield from out.rest()


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: Fraction) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (or of ``left`` with itself) are similar enough."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[gram] > 1  # a gram of one set is in no intersection
    gram, owner = gram[kept], owner[kept]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    gram = np.cumsum(np.concatenate([[0], np.diff(gram) != 0])) if len(gram) else gram
    k = len(left)
    common = np.zeros((k, len(sets) - k if right is not None else k), np.float32)
    width = 4096
    for first in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        lo, hi = np.searchsorted(gram, [first, first + width])
        block = np.zeros((len(sets), min(width, int(gram[-1]) + 1 - first)), np.float32)
        block[owner[lo:hi], gram[lo:hi] - first] = 1
        common += block[:k] @ (block[k:] if right is not None else block).T
    common = common.astype(np.int64)
    other = sizes[k:] if right is not None else sizes
    union = sizes[:k, None] + other[None, :] - common
    made = common * threshold.denominator >= union * threshold.numerator
    made &= union > 0
    if right is None:
        np.fill_diagonal(made, False)
    return made


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of a square, symmetric table."""
    left, made = np.ones(len(adjacent), bool), []
    for i in range(len(adjacent)):
        if left[i]:
            reached, frontier = np.zeros(len(adjacent), bool), np.zeros(len(adjacent), bool)
            frontier[i] = True
            while frontier.any():
                reached |= frontier
                frontier = adjacent[frontier].any(0) & ~reached
            left &= ~reached
            made += [(j, i) for j in np.flatnonzero(reached).tolist() if j != i]
    return made


VERIFIED = "cls binary, linked long, other binary"


def _verify(group: pd.DataFrame, threshold: Fraction) -> pd.DataFrame:
    out: list[tuple] = []

    def emit(cls: list, docs: np.ndarray, made: np.ndarray) -> None:
        counts = made @ docs
        out.extend((cls[i], int(counts[i]), None) for i in np.flatnonzero(counts))

    for _, part in group.groupby("root", sort=False):
        part = part.drop_duplicates(["cls", "side"])
        sides = [g for _, g in part.groupby("side", sort=True)]
        cls = [g["cls"].tolist() for g in sides]
        sets = [[np.frombuffer(b, np.uint64) for b in g["grams"]] for g in sides]
        docs = [g["docs"].to_numpy(np.int64) for g in sides]
        if len(sides) == 1:
            if part["alone"].iloc[0] and len(cls[0]) > 1:
                made = linked(sets[0], None, threshold)
                emit(cls[0], docs[0], made)
                out.extend((cls[0][i], 0, cls[0][j]) for i, j in forest(made))
            continue
        made = linked(sets[0], sets[1], threshold)
        emit(cls[0], docs[1], made)
        emit(cls[1], docs[0], made.T)
        k, m = made.shape
        whole = np.zeros((k + m, k + m), bool)
        whole[:k, k:], whole[k:, :k] = made, made.T
        names = cls[0] + cls[1]
        out.extend((names[i], 0, names[j]) for i, j in forest(whole))
    return pd.DataFrame(out, columns=["cls", "linked", "other"])


def classes(docs: DataFrame, n: int = WORDS, threshold: Fraction = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): doc_id and cls of every row; of every class its number of documents
    (docs), smallest id (first), component (root) and number of documents linked to it (linked).

    Runs jobs; intermediate tables go below the shared folder.
    """
    bands, width = bands_for(float(threshold), recall, most_hashes)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A row's own name, from id and text: ids may be null or repeat, and names are never null.
    plain = plain.withColumn("own", F.xxhash64("doc_id", "text"))
    signed = written(
        plain.mapInArrow(partial(_sign, n=n, bands=bands, width=width), "doc_id long, own long, cls binary, grams long, bands array<long>"), "signed"
    )
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("least")
    classes_ = signed.groupBy("cls").agg(F.count("*").alias("docs"), least, F.max("grams").alias("grams"))
    classes_ = written(classes_.select("cls", "docs", F.col("least.doc_id").alias("first"), F.col("least.own").alias("want"), "grams"), "classes")
    # one row of each class shows its bands, and only whole copies of it have its name
    shown = signed.join(classes_.select("cls", F.col("want").alias("own")), ["cls", "own"])
    # Candidates go by half of a class's name. Should two classes share it, both are candidates.
    half = F.xxhash64("cls")
    banded = shown.groupBy("cls").agg(F.first("bands").alias("bands")).select(half.alias("half"), F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("half").alias("hub"), F.max("half").alias("last")).where("hub <> last")
    stars = banded.join(hubs.select("band", "hub"), "band").where("half <> hub").select(F.col("half").alias("a"), F.col("hub").alias("b"))
    found = components(stars)
    member = found.toDF("half", "root").union(found.select("root", "root").distinct())
    member = member.join(classes_.withColumn("half", half), "half").drop("half")
    size = member.groupBy("root").agg(F.count("*").alias("sets"), F.sum("grams").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long")
    asked = written(member.drop("grams").join(size.select("root", blocks.alias("blocks")), "root"), "asked")
    # the same join at any size: few of the texts are asked for, but too many to broadcast
    texts = plain.join(asked.hint("merge"), plain["own"] == asked["want"])
    # whole copies go here: they lie together after the join
    texts = texts.groupBy("own", "cls").agg(*[F.first(c).alias(c) for c in ("text", "root", "blocks", "docs")]).select("text", "cls", "root", "blocks", "docs")
    sets = texts.mapInArrow(partial(_sets, n=n), "cls binary, root long, blocks long, docs long, grams binary")
    tasks = max(8, asked.agg(F.count("*").alias("n")).first().n // 1000)
    # a component of one block shares a group with others; of more, each pair of blocks is a group
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")),
    )
    spread = sets.withColumn("own", own).withColumn("pair", F.explode(pairs))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "pair"))
    dealt = spread.select(
        task.alias("task"),
        F.struct("root", "pair.i", "pair.j").cast("string").alias("root"),
        F.when(F.col("own") == F.col("pair.i"), 0).otherwise(1).alias("side"),
        (F.col("pair.i") == F.col("pair.j")).alias("alone"),
        "cls",
        "docs",
        "grams",
    )
    verified = written(dealt.groupBy("task").applyInPandas(partial(_verify, threshold=threshold), VERIFIED), "verified")
    counts = verified.where("other is null").groupBy("cls").agg(F.sum("linked").alias("linked"))
    group = components(verified.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    labelled = (
        classes_.join(group.toDF("cls", "root"), "cls", "left")
        .join(counts, "cls", "left")
        .select("cls", "docs", "first", F.coalesce("root", "cls").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    )
    return signed.select("doc_id", "cls"), written(labelled, "labelled")


def join(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: class_id (smallest id of all that are connected by links), copy_id
    (smallest id with the same n-grams) and n_links (other documents at the threshold or above).

    ``settings`` are those of ``classes``.
    """
    signed, labelled = classes(docs, **settings)
    smallest = labelled.groupBy("root").agg(F.min("first").alias("class_id"))
    facts = labelled.join(smallest, "root").select("cls", "class_id", F.col("first").alias("copy_id"), (F.col("docs") - 1 + F.col("linked")).alias("n_links"))
    return signed.join(facts, "cls").select("doc_id", "class_id", "copy_id", "n_links")


def _with_class(batches: Iterator[pa.RecordBatch], n: int, name: str) -> Iterator[pa.RecordBatch]:
    grams = Grams(n)
    for batch in batches:
        made = [class_of(grams(text)) for (text,) in rows(batch, "text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, name])


def keep_one(docs: DataFrame, n: int = WORDS, **settings) -> DataFrame:
    """One document of each group of connected ones: that with the smallest id, unchanged.

    A missing id is larger than any other; of equal ids in one class any one row stays.
    """
    _, labelled = classes(docs, n, **settings)
    best = labelled.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "cls")).alias("b"))
    own = unused_prefix(docs)
    name, wanted, first = (own + x for x in ("cls", "best", "first"))
    best = best.select(F.col("b.cls").alias(wanted), F.col("b.first").alias(first))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    keyed = docs.mapInArrow(partial(_with_class, n=n, name=name), schema)
    kept = keyed.join(best, (keyed[name] == best[wanted]) & keyed["doc_id"].cast("long").eqNullSafe(best[first]), "left_semi")
    return kept.dropDuplicates([name]).drop(name)
