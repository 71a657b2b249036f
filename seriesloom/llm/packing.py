"""Packing of tokenised documents: shortest-pack-first over the histogram of lengths.

A document is cut into pieces of at most ``size`` tokens; only its last piece can be shorter. The
histogram of piece lengths has ``size`` entries however large the corpus is. Over it, lengths are
placed longest first, each into the pack with the most space left among those it fits; a pack
stands for a count of equal packs (a pattern), so one placement moves any number of documents. The
patterns then join back to the pieces: a piece's rank among those of its length says which pattern,
which copy of it and which offset it gets.

Ranks come from positions inside the tasks that tokenised plus the sums of the counts of earlier
tasks, so no task holds all pieces of a frequent length.

Defined cases: a null text counts as empty; an empty document is the single end token; equal rows
are packed one by one; ids may repeat or be null; a table without rows gives no pieces; other
columns are ignored. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import Out, rows
from seriesloom.session import written

SIZE, END = 1024, 0
LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
BLANK = " \n\t\r"
# The vocabulary's own word pattern has a boundary in front of any run of these blanks, and between
# a letter and these signs.
CHUNK = re.compile(
    rf"[{BLANK}]*[{LETTERS}]+(?![^\s.,;:!?])|(?<=[{LETTERS}])[.,;:!?]+(?![^{BLANK}])|[{BLANK}]*[^{BLANK}]+|[{BLANK}]+"
)
OTHER_BLANK = re.compile("[" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in BLANK) + "]")
#: Bytes of words that a worker keeps, half of them only as long as its task runs; one slice of text.
MOST_KEPT, PER_WORD, SLICE = 64 << 20, 220, 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers; repeated words are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes behind each id: the vocabulary writes a byte as one character.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        # words of now and of before: only those that come again outlive a change
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.kept = 0

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of some texts, of about a slice together or one longer text."""
        listed = [None if not t or len(t) > SLICE or OTHER_BLANK.search(t) else CHUNK.findall(t) for t in texts]
        self.prepare(set().union(*filter(None, listed)))
        made = [None if chunks is None else b"".join(map(self.cache.__getitem__, chunks)) for chunks in listed]
        for text, ids in zip(texts, made, strict=True):
            if ids is not None:
                yield ids
            elif text and len(text) > SLICE and not OTHER_BLANK.search(text):
                yield b"".join(self.long(text))
            else:
                yield self.plain([text])[0].tobytes() if text else b""

    def long(self, text: str) -> Iterator[bytes]:
        chunks: list[str] = []
        for m in CHUNK.finditer(text):  # keeps the list of chunks short
            chunks.append(m[0])
            if len(chunks) == SLICE // 8:
                yield from self.parts(chunks)
                chunks = []
        yield from self.parts(chunks)

    def parts(self, chunks: list[str]) -> Iterator[bytes]:
        self.prepare(set(chunks))
        yield b"".join([self.cache[c] for c in chunks])

    def prepare(self, chunks: set[str]) -> None:
        """Have all of these in the cache."""
        if self.kept > MOST_KEPT // 2:
            self.before, self.cache, self.kept = self.cache, {}, 0
        fresh = chunks.difference(self.cache)
        self.kept += PER_WORD * len(fresh) + 3 * sum(map(len, fresh))
        before = self.before
        known = {c: before[c] for c in fresh if c in before}
        self.cache.update(known)
        self.learn([c for c in fresh if c not in known])

    def learn(self, fresh: list[str]) -> None:
        # Words behind one blank keep their boundaries when joined, and are cheaper to encode so.
        joined = [c for c in fresh if len(c) > 1 and c[0] in BLANK and c[1] not in BLANK]
        groups = [joined[i : i + 512] for i in range(0, len(joined), 512)]
        for group, ids in zip(groups, self.plain(["".join(g) for g in groups]), strict=True):
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in group])
            cuts = np.searchsorted(np.cumsum(self.width[ids]), ends, "left") + 1
            data, at = ids.tobytes(), 0
            for c, cut in zip(group, (4 * cuts).tolist(), strict=True):
                self.cache[c] = data[at:cut]
                at = cut
        others = [c for c in fresh if len(c) < 2 or c[0] not in BLANK or c[1] in BLANK]
        self.cache.update(zip(others, [x.tobytes() for x in self.plain(others)], strict=True))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, which keeps its words from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slice int, nth long"


def groups(found: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (id, text) in lists of about a slice of text."""
    group, size = [], 0
    for row in found:
        group.append(row)
        size += len(row[1] or "")
        if size >= SLICE or len(group) >= 1024:
            yield group
            group, size = [], 0
    if group:
        yield group


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    encode, seen = encoder(path), np.zeros(size + 1, np.int64)
    slice_ = TaskContext.get().partitionId()
    last = np.array([end], "<u4").tobytes()
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
    out = Out(pa.schema([(c.split()[0], k) for c, k in zip(PIECES.split(", "), kinds, strict=True)]))
    for group in groups(row for batch in batches for row in rows(batch, "doc_id", "text")):
        for (doc_id, _), made in zip(group, encode([text or "" for _, text in group]), strict=True):
            ids = made + last
            total = len(ids) // 4
            for start in range(0, total, size):
                piece = ids[4 * start : 4 * (start + size)]
                n = len(piece) // 4
                if out.add(doc_id, start, n, zlib.crc32(piece), total, slice_, int(seen[n])):
                    yield out.take()
                seen[n] += 1
    encode.before = {}
    yield from out.rest()


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in each) by shortest-pack-first over ``length: count``."""
    packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by space left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((s for s in range(size - 1, length - 1, -1) if packs.get(s)), None)
            if room is None:
                # one after the other: each opens a pack or joins the one just opened
                each = size // length
                if left >= each:
                    packs[size - each * length].append((left // each, [length] * each))
                if left % each:
                    packs[size - left % each * length].append((1, [length] * (left % each)))
                break
            n, pack = packs[room].pop()
            used = min(n, left)
            if n > used:
                packs[room].append((n - used, pack))
            packs[room - length].append((used, [*pack, length]))
            left -= used
    return [(n, pack) for room in sorted(packs) for n, pack in packs[room]]


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """(length, first rank, rank after the last, first sequence, offset) by length and first rank."""
    used: dict[int, int] = defaultdict(int)
    made, sequence = [], 0
    for n, pack in patterns:
        offset = 0
        for length in pack:
            made.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(made), np.int64).reshape(-1, 5)


def _assign(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = {}
    for i, length in enumerate(table[:, 0].tolist()):
        starts.setdefault(length, []).append(i)
    groups = {length: (table[at, 1], table[at]) for length, at in starts.items()}
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for value in np.unique(length).tolist():
            firsts, own = groups[value]
            at = np.flatnonzero(length == value)
            found = own[np.searchsorted(firsts, rank[at], "right") - 1]
            sequence[at], offset[at] = found[:, 3] + rank[at] - found[:, 1], found[:, 4]
        keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"]
        )


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: where it starts in its document, and its sequence and offset there.

    Runs a job: the pieces (numbers only, no ids) are written once below the shared folder.
    """
    run = partial(_pieces, path=path or vocabulary_path(), size=size, end=end)
    pieces = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES), "pieces")
    per_task = pieces.groupBy("slice", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    table = slots(pack_histogram(histogram, size))
    ranked = pieces.join(offsets.select("slice", "length", "before"), ["slice", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        partial(_assign, table=table),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
