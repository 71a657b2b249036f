"""Class-based n-gram language model with classes from exchange clustering (Brown et al. 1992).

Tokens are words between ASCII white space, A-Z lower-cased, and an end token per text. The most
frequent words are clustered first: exchange moves one word at a time to the class that raises the
likelihood most, with all other words as one fixed node. Then every other training word gets a class
in distributed rounds, by the classes of all its neighbours: first those of the frequent words, in
later rounds those of all words. A token's probability is that of its class after the class before,
times that of its word in the class. A word that training texts don't have goes by its last two
bytes to a bucket in the class where most training words with these bytes are.

Texts are cut into words once. A task puts its texts into chunks with a bounded dictionary; a chunk
is a row of that dictionary and the places of all words in it, learnt texts first, and every later
pass reads these numbers. What belongs to a word goes by rows: the neighbours of a chunk's words are
summed by word, and every chunk gets counts and classes of its own words back. Nothing that grows
with the vocabulary is broadcast or collected, and a chunk's size doesn't depend on any key, so that
no id can make one large. Tables that are no longer needed are deleted on the way.

Defined cases: a null text counts as empty, an empty text is one end token; without any training
text all counts are 0 and every token has the probability 2 / (V + 1) of the empty vocabulary, that
is 1; equal rows are scored one by one; ids may repeat or be null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Out, fold_number, rows
from seriesloom.session import intermediate, written

WORDS, GROUPS, CLASSES, ROUNDS = 1500, 256, 64, 12
REST = 1  # node, and class, of words without a class yet
ASSIGNED = 2  # rounds for the words that exchange has not placed
TEST_FOLD, FOLDS = 1, 5
END = b""
#: A chunk ends with this many different words, or tokens.
MOST_WORDS, MOST_TOKENS = 300_000, 1 << 21


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def group_of(word: bytes, groups: int) -> int:
    return zlib.crc32(word[-2:]) % groups


CHUNK = "chunk long, n long, words binary, docs binary, own binary"
DOC = np.dtype([("id", "<i8"), ("size", "<i8"), ("none", "?"), ("held_out", "?")])


class Places(dict):
    """Place of every word in the order of its first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self)
        return made


def _chunks(batches: Iterator[pa.RecordBatch], test_fold: int, folds: int) -> Iterator[pa.RecordBatch]:
    """Chunks: number of training tokens, words, texts (training ones first), and the place of every token's word."""
    press = zstandard.ZstdCompressor(level=3)
    chunk = TaskContext.get().partitionId() << 24
    at, texts, size = Places({END: 0}), ([], []), 0

    def made() -> pa.RecordBatch:
        listed = texts[0] + texts[1]
        docs = np.array([(doc_id or 0, len(own), doc_id is None, i >= len(texts[0])) for i, (doc_id, own) in enumerate(listed)], DOC)
        own = np.concatenate([x for _, x in listed])
        planes = own.view(np.uint8).reshape(-1, 4).T.tobytes()  # high bytes are mostly 0
        n = sum(len(x) for _, x in texts[0])
        return pa.RecordBatch.from_pydict(
            {"chunk": [chunk], "n": [n], "words": [press.compress(b" ".join(at))], "docs": [press.compress(docs.tobytes())], "own": [press.compress(planes)]}
        )

    for batch in batches:
        for doc_id, text in rows(batch, "doc_id", "text"):
            found = tokens((text or "").encode("utf-8", "surrogatepass"))
            own = np.fromiter(map(at.__getitem__, found), np.uint32, len(found))
            texts[fold_number(doc_id, folds) == test_fold].append((doc_id, own))
            size += len(own)
            if len(at) >= MOST_WORDS or size >= MOST_TOKENS:
                yield made()
                chunk += 1
                at, texts, size = Places({END: 0}), ([], []), 0
    if size:
        yield made()


def _words(data: bytes) -> list[bytes]:
    """A chunk's words by their places; the end token is the first, and no word has a blank."""
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def _places(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def _learnt(own: bytes, n: int) -> np.ndarray:
    """Places of the training tokens, behind an end token."""
    return np.concatenate([[0], _places(own)[:n].astype(np.int64)])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The training words of every chunk and their counts in it."""
    for batch in batches:
        for n, words, own in rows(batch, "n", "words", "own"):
            names = pa.array(_words(words), pa.binary())
            counts = np.bincount(_places(own)[:n], minlength=len(names))
            made = pa.RecordBatch.from_arrays([names, pa.array(counts, pa.int64())], ["word", "n"])
            yield from _sliced(made.filter(pa.array(counts > 0)))


def _sliced(batch: pa.RecordBatch, most: int = 16_384) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), most):
        yield batch.slice(at, most)


def _of_words(names: list[bytes], value: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter(map(value.get, names, repeat(other)), np.int64, len(names))


def _pairs(batches: Iterator[pa.RecordBatch], node: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Neighbouring nodes of training texts and how often they stand together."""
    nodes = len(node) + 1
    total = np.zeros(nodes * nodes, np.int64)
    for batch in batches:
        for n, words, own in rows(batch, "n", "words", "own"):
            made = _of_words(_words(words), node, REST)[_learnt(own, n)]
            total += np.bincount(made[:-1] * nodes + made[1:], minlength=nodes * nodes)
    cells = np.flatnonzero(total)
    for at in range(0, len(cells), 65_536):
        cell = cells[at : at + 65_536]
        yield pa.RecordBatch.from_pydict({"a": cell // nodes, "b": cell % nodes, "n": total[cell]})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS, fixed: tuple[int, ...] = (0,)) -> np.ndarray:
    """Class of every node; ``pairs[i, j]`` counts node j right after node i.

    Fixed nodes keep a class of their own, the first ones. Every move raises the likelihood.
    """
    nodes = len(pairs)
    classes = max(len(fixed) + 1, min(classes, nodes))
    own = np.empty(nodes, np.int64)
    free = [i for i in np.argsort(-pairs.sum(0), kind="stable").tolist() if i not in fixed]
    for k, i in enumerate(fixed):
        own[i] = k
    first = len(fixed)
    for k, i in enumerate(free):
        own[i] = first + k % (classes - first)
    pairs = pairs.astype(np.float64)
    hot = np.zeros((nodes, classes))
    hot[np.arange(nodes), own] = 1
    table = hot.T @ pairs @ hot
    for _ in range(rounds):
        moved = 0
        for w in free:
            both = pairs[w, w]
            out_, in_ = np.bincount(own, pairs[w], classes), np.bincount(own, pairs[:, w], classes)
            a = own[w]
            out_[a] -= both
            in_[a] -= both
            if out_.sum() + in_.sum() + both == 0:
                continue
            table[a] -= out_
            table[:, a] -= in_
            table[a, a] -= both
            left, right = table.sum(1), table.sum(0)
            plain = _xlogx(table)
            gain = (_xlogx(table + out_[None, :]) - plain).sum(1) + (_xlogx(table + in_[:, None]) - plain).sum(0)
            d = np.diagonal(table)
            gain += _xlogx(d + out_ + in_ + both) + _xlogx(d) - _xlogx(d + out_) - _xlogx(d + in_)
            gain -= _xlogx(left + out_.sum() + both) - _xlogx(left) + _xlogx(right + in_.sum() + both) - _xlogx(right)
            gain[:first] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            moved += b != a
            own[w] = b
            table[b] += out_
            table[:, b] += in_
            table[b, b] += both
        if not moved:
            break
    return own


class Model:
    """Class of each node, and log10 probabilities of class after class and of node in class."""

    def __init__(self, node: dict[bytes, int], own: np.ndarray, pairs: np.ndarray, group_tokens: list[int], group_words: list[int]):
        self.node, self.own = node, own
        self.group_tokens, self.group_words = group_tokens, group_words
        classes = int(own.max()) + 1
        hot = np.zeros((len(own), classes))
        hot[np.arange(len(own)), own] = 1
        table = hot.T @ pairs @ hot
        counts = pairs.sum(0)
        per_class = hot.T @ counts
        plain = (per_class + 0.5) / (per_class.sum() + 0.5 * classes)
        mass = 5.0
        self.after = np.log10((table + mass * plain[None, :]) / (table.sum(1, keepdims=True) + mass))
        self.inside = np.log10((counts + 0.5) / (per_class + 0.5 * hot.sum(0))[own])


NEIGHBOURS = "word binary, chunk long, at int, near binary"
NEAR = np.dtype([("k", "<u2"), ("n", "<u4")])


def _kinds(names: list[bytes], frequent: dict[bytes, int], cls: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a chunk's words, and which words are not frequent."""
    known = _of_words(names, frequent, -1)
    rare = known < 0
    placed = np.full(len(names), REST)
    if cls is not None:
        found = np.frombuffer(zstandard.ZstdDecompressor().decompress(cls), "<u2")
        placed[: len(found)] = found
    return np.where(rare, placed, known), rare


def _followers(batches: Iterator[pa.RecordBatch], frequent: dict[bytes, int], classes: int) -> Iterator[pa.RecordBatch]:
    """How often class follows class in training texts."""
    table = np.zeros(classes * classes, np.int64)
    for batch in batches:
        for n, words, own, cls in rows(batch, "n", "words", "own", "cls"):
            kind = _kinds(_words(words), frequent, cls)[0][_learnt(own, n)]
            table += np.bincount(kind[:-1] * classes + kind[1:], minlength=classes * classes)
    cell = np.flatnonzero(table)
    yield pa.RecordBatch.from_pydict({"cell": cell, "n": table[cell]})


def _neighbours(batches: Iterator[pa.RecordBatch], frequent: dict[bytes, int], classes: int) -> Iterator[pa.RecordBatch]:
    """Classes before and after every chunk's words that are not frequent; none for words without training texts."""
    for batch in batches:
        for chunk, n, words, own, cls in rows(batch, "chunk", "n", "words", "own", "cls"):
            names = _words(words)
            kind, rare = _kinds(names, frequent, cls)
            listed = _learnt(own, n)
            left, right = listed[:-1], listed[1:]
            before, after = rare[right], rare[left]
            key = np.concatenate([right[before] * (2 * classes) + kind[left[before]], left[after] * (2 * classes) + classes + kind[right[after]]])
            key, count = np.unique(key, return_counts=True)
            cells = np.empty(len(key), NEAR)
            cells["k"], cells["n"] = key % (2 * classes), count
            ends = np.cumsum(np.bincount(key // (2 * classes), minlength=len(names)))
            offsets = np.concatenate([[0], ends * NEAR.itemsize]).astype("<i4")
            near = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(cells.tobytes())])
            made = [pa.array(names, pa.binary()), pa.array(np.full(len(names), chunk)), pa.array(np.arange(len(names), dtype=np.int32)), near]
            yield from _sliced(pa.RecordBatch.from_arrays(made, ["word", "chunk", "at", "near"]).filter(pa.array(rare)))


def best_classes(near: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class, after the fixed ones, under which each word's neighbours are likeliest; ``near`` has classes before, then after."""
    classes = len(table)
    seen = np.log(table + 0.5)
    size = np.log(table.sum(0) + 0.5 * classes) + np.log(table.sum(1) + 0.5 * classes)
    before, after = near[:, :classes], near[:, classes:]
    gain = before @ seen + after @ seen.T - before.sum(1)[:, None] * size[None, :]
    return REST + 1 + gain[:, REST + 1 :].argmax(1)


ASSIGNMENTS = "chunk long, at int, n long, cls int, tail binary"


def _heads(column: pa.Array) -> np.ndarray:
    """Where another value starts."""
    changed = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], changed]))


def _cells(near: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a column behind each other, and how many each row has."""
    offsets = np.frombuffer(near.buffers()[1], "<i4")[near.offset : near.offset + len(near) + 1]
    data = near.buffers()[2]
    whole = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return whole.view(NEAR), np.diff(offsets) // NEAR.itemsize


def _assign(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and class of every word, for each chunk that has it; rows of one word stand behind each other.

    The first row of a word also has its last bytes.
    """
    width = 2 * len(table)

    def solved(whole: pa.RecordBatch, heads: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff([*heads.tolist(), len(whole)])
        word = np.repeat(np.arange(len(heads)), sizes)
        cells, count = _cells(whole["near"])
        near = np.bincount(np.repeat(word, count) * width + cells["k"], cells["n"].astype(np.float64), len(heads) * width).reshape(-1, width)
        n = near[:, : len(table)].sum(1).astype(np.int64)
        cls = best_classes(near, table).astype(np.int32)
        first = np.zeros(len(whole), bool)
        first[heads] = True
        tail = pc.if_else(pa.array(first), pc.binary_slice(whole["word"], -2), None)
        return pa.RecordBatch.from_arrays([whole["chunk"], whole["at"], pa.array(n[word]), pa.array(cls[word]), tail], ["chunk", "at", "n", "cls", "tail"])

    def blocks(whole: pa.RecordBatch, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(heads), 2048):
            end = int(heads[i + 2048]) if i + 2048 < len(heads) else len(whole)
            yield solved(whole.slice(int(heads[i]), end - int(heads[i])), heads[i : i + 2048] - heads[i])

    rest = None
    for batch in batches:
        whole = batch if rest is None else pa.concat_batches([rest, batch])
        if not len(whole):
            continue
        heads = _heads(whole["word"])
        yield from blocks(whole.slice(0, int(heads[-1])), heads[:-1])
        rest = whole.slice(int(heads[-1]))  # the last word may go on
    if rest is not None:
        yield from blocks(rest, np.array([0]))


PLACED = "chunk long, cls binary, counts binary"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes and counts of every chunk's words by their places, from its rows behind each other."""
    press = zstandard.ZstdCompressor(level=3)
    chunk, parts = None, []

    def made() -> pa.RecordBatch:
        at, n, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts, kinds = np.zeros(int(at.max()) + 1, "<i8"), np.full(int(at.max()) + 1, REST, "<u2")
        counts[at], kinds[at] = n, cls
        parts.clear()
        return pa.RecordBatch.from_pydict({"chunk": [chunk], "cls": [press.compress(kinds.tobytes())], "counts": [press.compress(counts.tobytes())]})

    for batch in batches:
        if not len(batch):
            continue
        of, columns = batch["chunk"].to_numpy(), [batch[c].to_numpy() for c in ("at", "n", "cls")]
        heads = [*_heads(batch["chunk"]).tolist(), len(batch)]
        for i, j in zip(heads[:-1], heads[1:], strict=True):
            if parts and of[i] != chunk:
                yield made()
            chunk = int(of[i])
            parts.append([c[i:j] for c in columns])
    if parts:
        yield made()


CLASSED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, kinds binary"


def _classed(
    batches: Iterator[pa.RecordBatch], frequent: dict[bytes, int], tops: dict[bytes, int], sizes: np.ndarray, buckets: np.ndarray, total: int, words: int
) -> Iterator[pa.RecordBatch]:
    """Counts and unigram score of every text, the score of its words inside their classes, and the classes."""
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    out = Out(pa.schema([(c.split()[0], k) for c, k in zip(CLASSED.split(", "), types, strict=True)]), most_bytes=8 << 20)
    for batch in batches:
        for listed, docs, own_, cls, placed in rows(batch, "words", "docs", "own", "cls", "counts"):
            names = _words(listed)
            kind, rare = _kinds(names, frequent, cls)
            counts = _of_words(names, tops, 0)
            if placed is not None:
                found = np.frombuffer(zstandard.ZstdDecompressor().decompress(placed), "<i8")
                counts[: len(found)] += found
            for i in np.flatnonzero(rare & (counts == 0)).tolist():
                kind[i] = buckets[group_of(names[i], len(buckets))]
            logs = np.log10((counts + 0.5) / (total + 0.5 * (words + 1)))
            inside = np.log10((counts + 0.5) / sizes[kind])
            small, known = kind.astype(np.min_scalar_type(len(sizes))), counts > 0
            places, at = _places(own_), 0
            for doc_id, size, none, held_out in np.frombuffer(zstandard.ZstdDecompressor().decompress(docs), DOC).tolist():
                own = places[at : at + size]
                at += size
                kinds = small[own].tobytes()
                values = (None if none else doc_id, held_out, size, int(known[own].sum()), float(logs[own].sum()), float(inside[own].sum()), kinds)
                if out.add(*values, weight=len(kinds)):
                    yield out.take()
    yield from out.rest()


def _followed(kinds: bytes, classes: int) -> np.ndarray:
    """Class before and class of every token, as one number."""
    kind = np.frombuffer(kinds, np.min_scalar_type(classes)).astype(np.int64)
    return np.concatenate([[0], kind[:-1]]) * classes + kind


def _table(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(classes * classes, np.int64)
    for batch in batches:
        for (kinds,) in rows(batch, "kinds"):
            table += np.bincount(_followed(kinds, classes), minlength=classes * classes)
    cell = np.flatnonzero(table)
    yield pa.RecordBatch.from_pydict({"cell": cell, "n": table[cell]})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], model: Model, total: int) -> Iterator[pa.RecordBatch]:
    after, classes = model.after.reshape(-1), len(model.after)
    for batch in batches:
        scores = [inside + float(after[_followed(kinds, classes)].sum()) for inside, kinds in rows(batch, "inside", "kinds")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")], pa.array([total] * len(scores), pa.int64()), batch.column("base_score"), pa.array(scores, pa.float64())],
            [c.split()[0] for c in SCORES.split(", ")],
        )


def _square(cells: DataFrame, classes: int) -> np.ndarray:
    """The table of summed cells: classes x classes."""
    made = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(classes * classes, np.int64)
    table[made["cell"].to_numpy()] = made["n"].to_numpy()
    return table.reshape(classes, classes)


def score(docs: DataFrame, words: int = WORDS, groups: int = GROUPS, classes: int = CLASSES, test_fold: int = TEST_FOLD, folds: int = FOLDS) -> DataFrame:
    """Counts, unigram score and class model score of every text. Runs jobs."""
    with intermediate(docs.sparkSession) as kept:
        return _scored(docs, kept, words, groups, classes, test_fold, folds)


def _scored(docs: DataFrame, kept: Callable, words: int, groups: int, classes: int, test_fold: int, folds: int) -> DataFrame:
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    chunks = kept(plain.mapInArrow(partial(_chunks, test_fold=test_fold, folds=folds), CHUNK), "chunks")
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    counts = chunks.select("n", "words", "own").mapInArrow(_listed, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = kept(counts.where(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(words), "top").collect()
    tops = {bytes(r.word): r.n for r in sorted(top, key=lambda r: (-r.n, bytes(r.word)))}
    node = {END: 0} | {w: i + 2 for i, w in enumerate(tops)}
    nodes = len(node) + 1
    classes = max(REST + 2, min(classes, nodes))
    # classes of the frequent words, all others being one node
    pairs = np.zeros((nodes, nodes), np.int64)  # (words + 2) squared at most
    made = chunks.select("n", "words", "own").mapInArrow(partial(_pairs, node=node), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    pairs[made["a"].to_numpy(), made["b"].to_numpy()] = made["n"].to_numpy()
    del made
    own = exchange(pairs, classes, fixed=(0, REST))
    frequent = {w: int(own[i]) for w, i in node.items()}
    hot = np.eye(classes, dtype=np.int64)[own]
    table = hot.T @ pairs @ hot

    # classes of all other training words
    known = chunks.withColumns({"cls": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")})
    sizes, words_in = np.zeros(classes), np.zeros((groups, classes))
    for round_ in range(ASSIGNED):
        if round_:
            table = _square(known.select("n", "words", "own", "cls").mapInArrow(partial(_followers, frequent=frequent, classes=classes), "cell long, n long"), classes)
        near = known.drop("docs", "counts").mapInArrow(partial(_neighbours, frequent=frequent, classes=classes), NEIGHBOURS)
        by_word = near.repartition("word").sortWithinPartitions("word")
        with intermediate(spark) as passing:
            assigned = passing(by_word.mapInArrow(partial(_assign, table=table), ASSIGNMENTS), f"classes{round_}")
            by_chunk = assigned.drop("tail").repartition("chunk").sortWithinPartitions("chunk")
            placed = kept(by_chunk.mapInArrow(_placed, PLACED), f"placed{round_}")
            if round_ == ASSIGNED - 1:
                # sizes of the classes, and the buckets of unseen words by their last bytes: groups x classes rows
                tail = F.pmod(F.crc32("tail"), F.lit(groups))
                trained = assigned.where("tail is not null and n > 0")
                for r in trained.groupBy(tail.alias("g"), "cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
                    sizes[r.cls] += r.n
                    words_in[r.g, r.cls] = r.v
        known = chunks.join(placed, "chunk", "left")
    buckets = np.where(words_in.any(1), words_in.argmax(1), REST)
    sizes = sizes + 0.5 * (words_in.sum(0) + np.bincount(buckets, minlength=classes) + np.bincount([*frequent.values()], minlength=classes))
    sizes += np.bincount([frequent[END], *[frequent[w] for w in tops]], [0, *tops.values()], classes)
    tops[END] = int(pairs[:, node[END]].sum())
    sizes[frequent[END]] += float(tops[END])
    different = int(words_in.sum()) + sum(n > 0 for n in tops.values())

    run = partial(_classed, frequent=frequent, tops=tops, sizes=sizes, buckets=buckets, total=total, words=different)
    texts = written(known.drop("chunk", "n").mapInArrow(run, CLASSED), "classed")
    table = _square(texts.where("not held_out").select("kinds").mapInArrow(partial(_table, classes=classes), "cell long, n long"), classes)
    model = Model({}, np.arange(classes), table, [], [])
    return texts.mapInArrow(partial(_score, model=model, total=total), SCORES)
