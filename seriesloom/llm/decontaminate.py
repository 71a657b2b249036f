"""Removal of benchmark passages: hashed windows of benchmark words against every document window.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A benchmark
item gives all its windows of 13 words, a shorter one its only window. Every document window is
hashed, from hashes of its words, and looked up among the benchmark's hashes, which are broadcast
while they are few; a hit is then compared word by word. Everything is DataFrame functions, nothing leaves the JVM.

The documents are only shuffled once, to bring the hits of a document back to it. A document's hits
are at most as many as its words; nothing is gathered by window, so that a passage in a third of
all documents costs as many rows as there are documents.

Defined cases: a null text has no words and is not contaminated, a null item has no windows; equal
rows get equal results; ids may repeat or be null; empty tables give no hits; other columns are kept
by ``remove`` and ignored by ``scan``.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import unused_prefix

WINDOW = 13
#: What stands between words. Matching the words takes far longer: Java tests a class with all of Unicode slowly.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Hashes up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def between_gaps(text: Column) -> Column:
    """Words of a text as they are; gaps at its ends leave empty ones, which go."""
    return F.array_remove(F.split(text, GAP), "")


def words(text: str | Column) -> Column:
    """Lower-cased words of a text."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ascii_only = F.octet_length(c) == F.length(c)
    low = F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))
    return between_gaps(low)


def paired(hashes: str, shift: int) -> Column:
    """Every hash with the one ``shift`` places on; at the end, where there is none, alone."""
    return F.zip_with(hashes, F.slice(hashes, shift + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def with_hashes(df: DataFrame, column: str, lengths: Iterable[int], prefix: str) -> DataFrame:
    """Columns ``prefix`` and each length: hashes of that many words from every word on.

    Hashes of 1, 2, 4... words are paired, the last two overlapping, so that a window costs a few
    numbers and not all its words. Windows beyond the last word are among them.
    """
    df, p = df.withColumn(f"{prefix}1", F.transform(column, lambda x: F.xxhash64(x))), 1
    for n in sorted(lengths):
        while 2 * p <= n:
            df = df.withColumn(f"{prefix}{2 * p}", paired(f"{prefix}{p}", p))
            p *= 2
        if n > p:
            df = df.withColumn(f"{prefix}{n}", paired(f"{prefix}{p}", n - p))
    return df


def whole_windows(hashes: str, length: int) -> Column:
    return F.slice(hashes, 1, F.greatest(F.size(hashes) - length + 1, F.lit(0)))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """length, hash, words and items of every distinct window."""
    listed = items.select(F.col("item_id").cast("string").alias("item"), words("text").alias("w")).where(F.size("w") > 0)
    listed = listed.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("length"))
    each = listed.select("item", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("i"))
    each = each.select("item", "length", F.slice("w", F.col("i"), F.col("length")).alias("gram"))
    grams = each.groupBy("length", "gram").agg(F.collect_set("item").alias("items"))
    hashed = with_hashes(grams, "gram", range(1, window + 1), "h")
    hash_ = F.coalesce(*[F.when(F.col("length") == n, F.get(f"h{n}", F.lit(0))) for n in range(1, window + 1)])
    return hashed.select("length", hash_.alias("hash"), "gram", "items")


def stands_at(words_: Column, at: Column, gram: Column) -> Column:
    """Word by word, whether a gram starts at word ``at``."""
    return F.forall(F.sequence(F.lit(0), F.size(gram) - 1), lambda k: F.get(words_, at - 1 + k) == F.get(gram, k))


def keyed(docs: DataFrame, prefix: str) -> DataFrame:
    """Two keys that only equal rows share; ids may be null or repeat."""
    return docs.withColumns(
        {
            f"{prefix}k1": F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(1)),
            f"{prefix}k2": F.xxhash64(F.lit(2), F.col("text"), F.col("doc_id")),
        }
    )


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, found: str = "__found") -> DataFrame:
    """All columns of ``docs`` and the column ``found``: n_words, n_hit, items (sorted texts)."""
    own = unused_prefix(docs)
    k1, k2, n_, hits_, w_ = (own + x for x in ("k1", "k2", "n", "hits", "w"))
    grams = benchmark_windows(items, window)
    # one small job: numbers of windows by length, 13 rows at most
    counts = {r.length: r.n for r in grams.groupBy("length").agg(F.count("*").alias("n")).collect()}
    fits = sum(counts.values()) <= MOST_BROADCAST
    side = (lambda df: F.broadcast(df)) if fits else (lambda df: df)
    keyed_docs = keyed(docs, own)
    split = with_hashes(keyed_docs.select(k1, k2, words("text").alias(w_)), w_, counts, own)
    if counts:
        each = reduce(
            DataFrame.unionByName,
            [split.select(k1, k2, F.lit(n).alias("length"), F.posexplode(whole_windows(f"{own}{n}", n)).alias("at", "hash")) for n in sorted(counts)],
        )
        hits = (
            each.join(side(grams), ["length", "hash"])
            .groupBy(k1, k2)
            .agg(F.collect_set(F.struct((F.col("at") + 1).alias("at"), "length", "gram", "items")).alias(hits_))
        )
    else:
        hits = split.select(k1, k2, F.lit(None).cast("array<struct<at:int,length:int,gram:array<string>,items:array<string>>>").alias(hits_)).limit(0)
    counted = keyed_docs.withColumn(n_, F.size(between_gaps(F.coalesce("text", F.lit("")))).cast("long"))
    both = counted.join(hits, [k1, k2], "left")
    # bound by a lambda, the words are made once a text and not once a hit
    sure = F.transform(F.array(words("text")), lambda w: F.filter(hits_, lambda x: stands_at(w, x["at"], x["gram"])))
    both = both.withColumn(hits_, F.when(F.col(hits_).isNotNull(), F.sort_array(F.get(sure, F.lit(0)))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        hits_,
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["at"] + x["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(acc["end"], x["at"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(hits_, lambda x: x["items"]))))
    facts = F.struct(
        F.col(n_).alias("n_words"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(names, F.array().cast("array<string>")).alias("items"),
    )
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], facts.alias(found))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """A twentieth of the words or more lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(scanned: DataFrame) -> DataFrame:
    words_, hit, items = (F.col(f"__found.{c}") for c in ("n_words", "n_hit", "items"))
    return scanned.select(
        "doc_id",
        words_.alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        contaminated(words_, hit).alias("contaminated"),
    )


def remove(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    found = f"{unused_prefix(docs)}found"
    scanned = scan(docs, items, window, found)
    return scanned.where(~contaminated(F.col(f"{found}.n_words"), F.col(f"{found}.n_hit"))).drop(found)
