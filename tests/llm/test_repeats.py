"""Removal of repeated windows, the index and the suffix order against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import runs, substring_dedup, suffix_dedup
from seriesloom.llm.fmindex import FMIndex
from seriesloom.llm.suffix_sort import suffixes
from tests.llm.fixtures import frame, hard_rows, without_repeats


def removed(rows, split, k, join):
    out = Counter()
    made = without_repeats(rows, split, k)
    for doc_id, text in rows:
        units, mask = made[doc_id, text]
        kept = join([units[i : i + 1] if isinstance(units, bytes) else units[i] for i in range(len(units)) if not mask[i]])
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        out[doc_id, len(units), sum(mask), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("most", [200_000, 3])
def test_words(spark, monkeypatch, most):
    monkeypatch.setattr(runs.hits, "__defaults__", (most,))
    rows = hard_rows()
    made = substring_dedup.deduplicate(frame(spark, rows), shard=2000).collect()
    wanted = removed(rows, bytes.split, 20, b" ".join)
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in made) == Counter(
        {(a, b, c, e): 0 for a, b, c, d, e in wanted}
    ) + sum((Counter({(a, b, c, e): n}) for (a, b, c, d, e), n in wanted.items()), Counter())


@pytest.mark.parametrize("most", [200_000, 3])
def test_bytes(spark, monkeypatch, most):
    monkeypatch.setattr(runs.hits, "__defaults__", (most,))
    rows = hard_rows(4)
    made = suffix_dedup.deduplicate(frame(spark, rows), shard=5000).collect()
    wanted = removed(rows, bytes, 100, b"".join)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in made) == wanted


def largest_group(batches):
    """Instead of the windows found: the size of the largest group of runs, as a range."""
    size = Counter()
    for batch in batches:
        size.update(batch.column("key").to_pylist())
    yield pa.RecordBatch.from_pylist([{"tk": b"", "start": n, "end": n} for n in sorted(size.values())[-1:]], GROUP)


GROUP = pa.schema([("tk", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])


def rows_with_a_heavy_key():
    """One text in which the gram with the smallest hash heads 300 different runs, and a text that repeats a part of it."""
    make = substring_dedup.word_units()
    heads = [f"h{i} a b c d e" for i in range(3000)]
    hashes = [int(runs.gram_hashes(make(h.encode())[0], 6)[0]) for h in heads]
    head = heads[hashes.index(min(hashes))].split()
    words = [w for i in range(300) for w in [*head, *[f"w{i}x{j}" for j in range(14)]]]
    return [(1, " ".join(words)), (2, " ".join(["new", *words[1007:1050], "end"]))]


def test_a_key_with_many_runs_in_one_text_is_not_kept_together(spark, monkeypatch):
    rows, most = rows_with_a_heavy_key(), 50
    group = lambda n: [r["start"] for x in runs.hits(frame(spark, rows), substring_dedup.word_units, largest_group, 20, 6, n)[1].collect() for r in x.ranges]
    assert max(group(100_000)) >= 300
    assert max(group(most)) <= most
    monkeypatch.setattr(runs.hits, "__defaults__", (most,))
    made = {r.doc_id: r.n_removed for r in substring_dedup.deduplicate(frame(spark, rows), shard=2000).collect()}
    assert made == {1: 0, 2: 43}


def test_empty_tables(spark):
    assert substring_dedup.deduplicate(frame(spark, [])).count() == 0
    assert suffix_dedup.deduplicate(frame(spark, [])).count() == 0


@pytest.mark.parametrize("memory", [1 << 20, 60])
def test_suffix_order_and_common_prefixes(memory):
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 150)))
        if trial % 3 == 0:
            t = np.tile(t, 3)
        if trial % 7 == 0:
            t = np.concatenate([t, np.full(40, 1), t])
        t = np.append(t, 0).astype(np.int64)
        cap = int(rng.integers(2, 60))
        order, common = suffixes(t, cap, memory)
        head = lambda i: t[i : i + cap].tolist()
        assert sorted(order.tolist()) == list(range(len(t)))
        heads = [head(i) for i in order]
        assert heads == sorted(heads)
        shared = [next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(heads, heads[1:])]
        assert common.tolist() == [0, *shared]


def test_suffix_order_with_a_large_alphabet():
    rng = np.random.default_rng(2)
    t = np.append(np.tile(rng.integers(1, 9000, 15_000), 2), 0).astype(np.int64)
    order, common = suffixes(t, 50)
    heads = [t[i : i + 50].tolist() for i in order]
    assert heads == sorted(heads) and (common >= 50).sum() > 14_000


def test_matching_statistics():
    rng = np.random.default_rng(3)
    t = np.append(rng.integers(1, 4, 300), 0)
    index = FMIndex(t, 9)
    ends = np.arange(20, 300)
    length, row = index.matching(t, ends, 8)
    text = t.tolist()
    for e, n, r in zip(ends.tolist(), length.tolist(), row.tolist(), strict=True):
        times = lambda m, e=e: sum(text[i : i + m] == text[e - m + 1 : e + 1] for i in range(len(text) - m + 1))
        assert n == max(m for m in range(9) if m == 0 or times(m) >= 2)
        assert (r >= 0) == (n == 8)


def test_runs_route_equal_windows_alike():
    rng = np.random.default_rng(5)
    units = runs.mixed(rng.integers(0, 3, 3000).astype(np.uint64))
    key, first, count, several = runs.runs_of(units, 20, 6)
    assert first[0] == 0 and (np.diff(first) == count[:-1]).all() and count.sum() == 2981
    of = np.repeat(key, count)
    run = np.repeat(np.arange(len(key)), count)
    seen = {}
    for i in range(2981):
        w = units[i : i + 20].tobytes()
        if w in seen:
            assert of[seen[w]] == of[i]
            assert run[seen[w]] != run[i] or several[run[i]]
        seen[w] = i
