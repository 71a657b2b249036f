"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram of letters (a
gap between words counts as one letter) is bound by multiplying the vectors of its letters, permuted
by their place; a text bundles the vectors of its trigrams, a language the unit bundles of its
texts. A document gets the language whose prototype has the largest cosine.

A prototype is a sum, so tasks add up their rows and hand on ``dims`` whole numbers per language:
that bound (languages x dims) is also the size of what is broadcast, whatever the corpus holds.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a language
label teach nothing; without any labelled row every text is ``und``; equal texts get equal results;
ties go to the language first in order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Out, fold_of, rows

DIMS, SEED, GRAIN = 1024, 20240229, 1 << 24
MOST_LANGUAGES = 5000
SLICE = 1 << 20
#: Texts and trigrams that are bundled together; trigrams whose vectors are in use at a time.
TEXTS, TRIGRAMS, BLOCK = 64, 1 << 16, 4096
MOST_LETTERS = 32_768


class Space:
    """Vectors of letters and trigrams, drawn on demand and kept up to a bound."""

    def __init__(self, dims: int, seed: int, most: int = 16_384):
        self.dims, self.seed, self.most = dims, seed, most
        self.letters: dict[int, int] = {}
        self.drawn = np.empty((0, dims), np.int8)
        self.known: dict[int, int] = {}
        self.vectors = np.empty((0, dims), np.int8)

    def of_letters(self, codes: np.ndarray) -> np.ndarray:
        """The letters' vectors, drawn from their code points."""
        listed, back = np.unique(codes, return_inverse=True)
        wanted = listed.tolist()
        fresh = [c for c in wanted if c not in self.letters]
        if len(self.letters) + len(fresh) > MOST_LETTERS:
            self.letters, self.drawn, fresh = {}, np.empty((0, self.dims), np.int8), wanted
        if fresh:
            base = len(self.letters)
            self.letters.update((c, base + i) for i, c in enumerate(fresh))
            new = [np.random.Generator(np.random.PCG64([self.seed, c])).integers(0, 2, self.dims, np.int8) * 2 - 1 for c in fresh]
            self.drawn = np.vstack([self.drawn[:base], np.array(new, np.int8)])
        return self.drawn[[self.letters[c] for c in wanted]][back]

    def of_trigrams(self, keys: np.ndarray) -> np.ndarray:
        """Each letter's vector permuted by its place, multiplied."""
        a, b, c = (self.of_letters(x) for x in (keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF))
        return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c

    def bundles(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of the trigrams' vectors by each row of weights, a block of trigrams at a time."""
        total = np.zeros((len(weights), self.dims))
        for at in range(0, len(keys), BLOCK):
            part = weights[:, at : at + BLOCK]
            if part.dtype == np.float32 and part.sum(1).max(initial=0) >= 1 << 24:
                part = part.astype(np.float64)  # whole numbers stay exact
            total += part @ self.rows(keys[at : at + BLOCK])
        return total

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of at most a block of distinct trigrams, as floats."""
        wanted = keys.tolist()
        fresh = [k for k in wanted if k not in self.known]
        if len(self.known) + len(fresh) > self.most:
            self.known, self.vectors, fresh = {}, np.empty((0, self.dims), np.int8), wanted
        if fresh:
            base = len(self.known)
            self.known.update((k, base + i) for i, k in enumerate(fresh))
            need = base + len(fresh)
            if need > len(self.vectors):
                grown = np.empty((max(need, min(self.most, 2 * len(self.vectors))), self.dims), np.int8)
                grown[:base] = self.vectors[:base]
                self.vectors = grown
            self.vectors[base:need] = self.of_trigrams(np.array(fresh, np.int64))
        return self.vectors[[self.known[k] for k in wanted]].astype(np.float32)


LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a whole text and their counts."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(text), SLICE):
        # a letter more than the slice on both sides keeps the trigrams that cross its ends
        codes = np.frombuffer(text[max(0, at - 2) : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = LETTER[np.minimum(codes, 0xFFFF)]
        if (codes > 0xFFFF).any():
            letter = letter.copy()
            big = np.flatnonzero(codes > 0xFFFF)
            letter[big] = [chr(c).isalpha() for c in codes[big]]
        if not letter.any():
            continue
        codes = np.where(letter, codes, 0).astype(np.int64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.concatenate([[0], codes[keep], [0]]) if at == 0 else np.concatenate([codes[keep], [0]])
        if len(codes) < 3:
            continue
        made, n = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
        if len(keys):
            both = np.concatenate([keys, made])
            keys, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        else:
            keys, counts = made, n
    return keys, counts


def grouped(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of several texts, and the texts' counts of them as a matrix."""
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    matrix = np.zeros((len(found), len(keys)), np.float32)
    at = 0
    for i, (k, n) in enumerate(found):
        matrix[i, back[at : at + len(k)]] = n
        at += len(k)
    return keys, matrix


def _learn(batches: Iterator[pa.RecordBatch], dims: int, seed: int) -> Iterator[pa.RecordBatch]:
    space, sums, waiting, size = Space(dims, seed), {}, [], 0

    def flush() -> None:
        keys, matrix = grouped([w[1:] for w in waiting])
        matrix /= np.sqrt((matrix.astype(np.float64) ** 2).sum(1, keepdims=True))
        langs = [w[0] for w in waiting]
        each = list(dict.fromkeys(langs))
        weights = np.array([matrix[[x == lang for x in langs]].astype(np.float64).sum(0) for lang in each])
        for lang, total in zip(each, space.bundles(keys, weights), strict=True):
            sums[lang] = sums.get(lang, 0) + np.rint(total * GRAIN).astype(np.int64)
        waiting.clear()

    for batch in batches:
        for text, lang in rows(batch, "text", "lang"):
            keys, counts = trigrams(text)
            if len(keys):
                waiting.append((lang, keys, counts))
                size += len(keys)
                if len(waiting) >= TEXTS or size >= TRIGRAMS:
                    flush()
                    size = 0
    if waiting:
        flush()
    for lang, total in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * dims, "dim": list(range(dims)), "total": total / 1.0})


def learn(labelled: DataFrame, dims: int = DIMS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language from the ``text`` and ``lang`` of the given rows."""
    made = (
        labelled.where("text is not null and lang is not null")
        .select("text", "lang")
        .mapInArrow(partial(_learn, dims=dims, seed=seed), "lang string, dim long, total double")
        .groupBy("lang", "dim")
        .agg(F.sum("total").alias("total"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("dim", "total"))).alias("vector"))
        .limit(MOST_LANGUAGES + 1)
        .collect()
    )
    if len(made) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for row in sorted(made, key=lambda x: x.lang):
        v = np.array([x.total for x in row.vector])
        out[row.lang] = v / (np.linalg.norm(v) or 1.0)
    return out


def _predict(batches: Iterator[pa.RecordBatch], prototypes: dict, dims: int, seed: int) -> Iterator[pa.RecordBatch]:
    space, names = Space(dims, seed), list(prototypes)
    table = np.array([prototypes[x] for x in names], np.float32).reshape(len(names), dims)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    for batch in batches:
        ids, found, where, size = [], [], [], 0
        out = Out(schema, most=1 << 40)
        results: dict[int, tuple[str, float]] = {}

        def flush() -> None:
            keys, matrix = grouped(found)
            # rounded, so that the cosine of a text doesn't hang on the texts beside it
            bundle = space.bundles(keys, matrix)
            length = np.sqrt((bundle**2).sum(1))
            cosine = np.round((bundle @ table.T.astype(np.float64)) / np.maximum(length, 1e-9)[:, None], 9)
            best = cosine.argmax(1)
            for i, at in enumerate(where):
                results[at] = (names[best[i]], float(min(1.0, max(0.0, cosine[i, best[i]]))))
            found.clear()
            where.clear()

        for at, (doc_id, text) in enumerate(rows(batch, "doc_id", "text")):
            ids.append(doc_id)
            keys, counts = trigrams(text or "") if names else ((), ())
            if len(keys):
                found.append((keys, counts))
                where.append(at)
                size += len(keys)
                if len(found) >= TEXTS or size >= TRIGRAMS:
                    flush()
                    size = 0
        if found:
            flush()
        for at, doc_id in enumerate(ids):
            out.add(doc_id, *results.get(at, ("und", 0.0)))
        yield from out.rest()


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""
    run = partial(_predict, prototypes=prototypes, dims=dims, seed=seed)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """Learn from the rows outside fold 0 of 5, predict all rows."""
    prototypes = learn(docs.where(fold_of() != 0), dims, seed)
    return predict(docs, prototypes, dims, seed).withColumn("held_out", fold_of() == 0)


def _accept(batches: Iterator[pa.RecordBatch], prototypes: dict, dims: int, seed: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = pa.RecordBatch.from_arrays(
            [pa.array(range(batch.num_rows), pa.int64()), batch.column(batch.schema.get_field_index("text"))], ["doc_id", "text"]
        )
        made = list(_predict(iter([plain]), prototypes, dims, seed))
        keep = [name != "und" and score >= least for m in made for _, name, score in rows(m, "doc_id", "lang_pred", "score")]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_known(docs: DataFrame, least: float, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """Rows whose text has a known language with at least the score ``least``, unchanged."""
    prototypes = learn(docs.where(fold_of() != 0), dims, seed)
    run = partial(_accept, prototypes=prototypes, dims=dims, seed=seed, least=least)
    return docs.mapInArrow(run, docs.schema)
