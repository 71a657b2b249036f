"""Token counts by byte-pair merging, without making identifiers.

A text is cut at the strings of the vocabulary's special tokens (one token each) and then into words
by the vocabulary's word pattern. The bytes of a word are a linked list of symbols; a heap holds its
adjacent pairs that have a rank. The lowest rank is popped and joined until none is left: a word has
as many tokens as it had bytes, less the merges. Counts of words are kept per worker within
``MOST_KEPT`` bytes, so frequent words are merged once.

A word of over ``LONG`` characters is first cut between bytes that stand side by side in no token, where no
merge can reach across. A long text is read word by word. Besides the text itself a task holds the
kept words and about 70 bytes for each byte of its longest uncuttable word.

Nothing is shuffled: each row is counted where it is read, and a lost task is simply run again.

Defined cases: a null text counts as empty, which has 0 bytes and 0 tokens; equal rows give equal rows;
ids may repeat or be null; a table without rows gives no rows; other columns are ignored. Only
byte-level byte-pair vocabularies without normaliser are read; others raise ``ValueError``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
MOST_KEPT, PER_WORD = 32 << 20, 180
SHORT, LONG, LONG_TEXT, SLICE = 256, 4096, 1 << 20, 256
#: Fixed value: the word pattern of byte-level vocabularies.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def unsettled(text: str) -> bool:
    """Whether a character is one that Unicode had not assigned, on which word patterns may differ."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class Merges(dict):
    """``merges[word]`` is the number of tokens of a word; counts are kept within a bound of bytes."""

    def __init__(self, path: str, most_kept: int = MOST_KEPT):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, words, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
        affixes = [model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")]
        if model["type"] != "BPE" or spec["normalizer"] or not plain or any(affixes):
            raise ValueError(f"{path} is no byte-level byte-pair vocabulary without normaliser")
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has special tokens that take more than their own string")
        letters, vocabulary = byte_letters(), model["vocab"]
        self.first = [vocabulary[c] for c in letters]
        #: (rank, id of the joined symbol) by the ids of the two, in one number.
        self.pairs: dict[int, tuple[int, int]] = {}
        value = {c: b for b, c in enumerate(letters)}
        #: Whether two bytes stand side by side in any token.
        self.beside = np.zeros((256, 256), bool)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocabulary[a] << 32 | vocabulary[b]] = (rank, vocabulary[a + b])
            self.beside[value[a[-1]], value[b[0]]] = True
        special = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # words of now and of before: only those that come again outlive a change
        self.before: dict[str, int] = {}
        self.most_kept, self.kept = most_kept // 2, 0

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            return sum(map(self.merged, self.cut(word.encode())))
        n = self.before.pop(word, 0) or self.merged(word.encode())
        self.kept += PER_WORD + 4 * len(word)
        if self.kept > self.most_kept:
            self.before, self.kept = dict(self), PER_WORD + 4 * len(word)
            self.clear()
        self[word] = n
        return n

    def cut(self, data: bytes) -> Iterator[bytes]:
        """The stretches between bytes that no token holds side by side."""
        values = np.frombuffer(data, np.uint8)
        last = 0
        for at in (np.flatnonzero(~self.beside[values[:-1], values[1:]]) + 1).tolist():
            yield data[last:at]
            last = at
        yield data[last:]

    def merged(self, data: bytes) -> int:
        """Initial symbols less merges."""
        n, pairs = len(data), self.pairs
        if n < 2:
            return n
        ids = [self.first[b] for b in data]
        heap = [found[0] << 40 | i for i in range(n - 1) if (found := pairs.get(ids[i] << 32 | ids[i + 1]))]
        if not heap:
            return n
        heapify(heap)
        before, after = range(-1, n - 1), range(1, n + 1)
        before, after = (list(before), list(after)) if n < SHORT else (array("q", before), array("q", after))
        left = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j == n:
                continue
            found = pairs.get(ids[i] << 32 | ids[j])
            if not found or found[0] != top >> 40:
                continue  # one of the two has been joined with another since
            ids[i], ids[j] = found[1], -1
            left -= 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if found := pairs.get(ids[i] << 32 | ids[j]):
                    heappush(heap, found[0] << 40 | i)
            if (h := before[i]) >= 0 and (found := pairs.get(ids[h] << 32 | ids[i])):
                heappush(heap, found[0] << 40 | h)
        return left

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        total, at = 0, 0
        for match in self.special.finditer(text):
            total += self.plain(text[at : match.start()]) + 1
            at = match.end()
        return total + self.plain(text[at:] if at else text)

    def plain(self, text: str) -> int:
        """Tokens of a text without strings of special tokens."""
        if unsettled(text):
            from tokenizers.pre_tokenizers import ByteLevel

            found = ByteLevel(add_prefix_space=False).pre_tokenize_str(text)
            return sum(self[text[a:b]] for _, (a, b) in found)
        if len(text) > LONG_TEXT:
            return sum(self[m[0]] for m in WORD.finditer(text))
        return sum(map(self.__getitem__, WORD.findall(text)))


_merges: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """The worker's table, which keeps its words from task to task."""
    if path not in _merges:
        _merges[path] = Merges(path)
    return _merges[path]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    table = merges(path)
    for batch in batches:
        texts = batch.column("text")
        tokens: list[int] = []
        for start in range(0, len(texts), SLICE):
            tokens.extend(table.count(t) if t else 0 for t in texts.slice(start, SLICE).to_pylist())
        counts = pa.array(tokens, pa.int64())
        sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), sizes, counts, pc.greater(counts, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: bytes, tokens, and whether they are more than ``limit``."""
    run = partial(_counted, path=path or vocabulary_path(), limit=limit)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
