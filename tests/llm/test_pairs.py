"""The Jaccard join, its components, and the removal of near-duplicates."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from seriesloom.llm import jaccard
from seriesloom.llm.components import components
from tests.llm.fixtures import frame, grams, hard_rows, jaccard_groups, words


def near_rows():
    rng = random.Random(9)
    rows = hard_rows()
    base = words(rng, 150)
    for i in range(60):  # a large group of near copies
        copy = list(base)
        copy[rng.randrange(150)] = f"v{i}"
        rows.append((100 + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [1000, 7])
def test_join_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = near_rows()
    made = jaccard.join(frame(spark, rows)).collect()
    wanted = Counter((doc_id, *x) for (doc_id, _), x in zip(rows, jaccard_groups(rows), strict=True))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in made) == wanted


def test_keep_one_keeps_one_of_each_group(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    made = jaccard.keep_one(docs)
    assert made.schema == docs.schema
    kept = [(r.doc_id, r.text) for r in made.collect()]
    groups = jaccard_groups(rows)
    # two different texts with the id 70 are two groups
    assert sorted(i for i, _ in kept) == sorted([*{g for g, _ in groups}, 70])
    assert len({grams(t) for _, t in kept}) == len(kept)


def test_empty_table(spark):
    assert jaccard.join(frame(spark, [])).count() == 0
    assert jaccard.keep_one(frame(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, width = jaccard.bands_for(0.8, 0.9999, 300)
    assert bands * width <= 300 and 1 - (1 - 0.8**width) ** bands >= 0.9999


def test_linked_counts_like_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(25)]
    made = jaccard.linked(sets, None, Fraction(1, 2))
    cross = jaccard.linked(sets[:10], sets[10:], Fraction(1, 2))
    for i in range(25):
        for j in range(25):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            want = 2 * len(a & b) >= len(a | b)
            assert made[i, j] == (want and i != j)
            if i < 10 <= j:
                assert cross[i, j - 10] == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    made = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert made == {**{i: 0 for i in range(1, 41)}, **{j: 100 for j in range(101, 160)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


CLASHES = ["__cls", "__best", "__first", "__k1", "__n", "__hits", "__found", "__w"]


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, *[f"{c}{n}" for c in CLASHES]) for n, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


def test_columns_named_like_internal_ones_stay(spark):
    from seriesloom.llm import decontaminate

    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "z"), (None, None), (4, "one two three")]
    docs = clashing(spark, rows)
    before = {tuple(r) for r in docs.collect()}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {r for r in before if r[0] != 2}
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    clean = decontaminate.remove(docs, items)
    assert clean.columns == docs.columns
    assert {tuple(r) for r in clean.collect()} == {r for r in before if r[0] != 4}


def test_rows_without_ids_do_not_multiply(spark):
    """Texts are found again by id and hash: as many rows as there are texts."""
    rows = [(None, f"t{i // 2} " + " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = jaccard.join(docs).collect()
    assert len(made) == 300 and {r.n_links for r in made} == {1}
    from seriesloom.llm import runs, substring_dedup

    seen = []
    keep = runs.written

    def note(df, label):
        table = keep(df, label)
        seen.append((label, table.count()))
        return table

    runs.written = note
    try:
        out = substring_dedup.deduplicate(docs).collect()
    finally:
        runs.written = keep
    assert len(out) == 300 and {r.n_removed for r in out} == {0}  # of rows without ids none comes earlier
    assert dict(seen)["runs"] <= 600
