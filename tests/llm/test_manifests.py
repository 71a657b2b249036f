"""Token counts, the Merkle manifest and whitening, against plain versions."""

import hashlib
import json
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import merkle, token_counts, whitening
from tests.llm.fixtures import frame, hard_rows

# ---- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path())


@pytest.fixture(scope="module")
def merges():
    return token_counts.Merges(token_counts.vocabulary_path())


def wanted(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


PIECE = st.sampled_from(
    ["a", "Bé", " ", "  ", "\n", "<|endoftext|>", "<|endof", "text|>", "'s", "'S", "1", "²", "日", "😀", "\t", "\x00", "՘", " ", "\x1c", "\x85", "the", " of", "!?"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE | st.characters(exclude_categories=["Cs"]), max_size=14))
def test_counts_equal_the_library(library, merges, parts):
    text = "".join(parts)
    assert merges.count(text) == wanted(library, text)


def test_words_of_all_assigned_characters(library, merges):
    for start in range(0, 0x110000, 3000):
        there = [chr(c) for c in range(start, min(start + 3000, 0x110000)) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
        text = "".join(f"a{c}1{c}! {c}" for c in there)
        assert not token_counts.unsettled(text) and merges.count(text) == wanted(library, text)
    assert token_counts.unsettled("a՘") and not token_counts.unsettled("é日")


def test_long_words(library, merges):
    rng = random.Random(5)
    letters = "".join(chr(rng.randrange(97, 123)) for _ in range(9000))
    signs = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(5000))
    for text in ("x" * 20_000, "ab" * 6000, letters, signs, " " * 9000 + "a", letters[:4096], letters[:4097]):
        assert merges.count(text) == wanted(library, text)
    assert len(list(merges.cut(signs.encode()))) > 1


def test_kept_words_are_bounded(library, monkeypatch):
    small = token_counts.Merges(token_counts.vocabulary_path(), 4000)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 500)
    for _, text in hard_rows():
        if text:
            assert small.count(text) == wanted(library, text)
    assert len(small) + len(small.before) <= 4000 // token_counts.PER_WORD


def test_count_tokens(spark, library):
    rows = [*hard_rows(), (90, "<|endoftext|><|endoftext|> a<|endoftext|>")]
    made = token_counts.count_tokens(frame(spark, rows), limit=50)
    assert made.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    plain = Counter((i, len((t or "").encode()), n := wanted(library, t or ""), n > 50) for i, t in rows)
    assert Counter(map(tuple, made.collect())) == plain
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with open(token_counts.vocabulary_path(), encoding="utf-8") as file:
        spec = json.load(file)
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normaliser"):
        token_counts.Merges(str(tmp_path / "v.json"))


# ---- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """Levels of digests from the lowest on."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_steps(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % 3
        out.append((level[start:i], level[i + 1 : start + 3]))
        i //= 3
    return out


def plain_audit(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in groups[s]])
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = plain_steps(trees[s], i) + plain_steps(top, g)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = plain_leaf((*r[:4], r[4].replace("\n", "")) if tampered else r)
            for left, right in steps:
                h = H(*left, h, *right)
            proof = H(*[x for left, right in steps for x in (*left, *right)])
            out.append((r[0], plain_leaf(r), trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"
CLASH = ", tree string, leaf string, pos string, n string, h0 string, nodes string, known string, steps string, part string, payload string, up string"


def records():
    rng = random.Random(9)
    rows = [(i, "hot", "en", None, f"a\nb{i}" if i % 3 else f"c{i}") for i in range(100)]
    rows += [(i, f"s{(i or 0) % 7}", None, 3, t) for i, t in hard_rows()]
    rows += [(5, None, "x", 1, None), (None, None, "x", 1, "é\n"), (7, "", "x", 1, "z"), (8, "alone", None, None, "\n"), (8, "é", None, None, "\n")]
    rows += [(200, "copies", "en", 1, "same\n")] * 30 + [(200, "copies", "en", 2, "other")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("every", [1, 2, 4])
def test_manifest(spark, every):
    rows = records()
    docs = spark.createDataFrame([(*r, *["z"] * 11) for r in rows], FIELDS + CLASH).repartition(5)
    made = merkle.audit(docs, every)
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(map(tuple, made.collect()))
    assert found == Counter(plain_audit(rows))
    assert {v for *_, v in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 81, 82, 243, 250])
def test_one_tree_of_any_size(spark, n):
    rows = [(i, "s", "l", 1, f"t\n{i}") for i in range(n)]
    assert Counter(map(tuple, merkle.audit(spark.createDataFrame(rows, FIELDS)).collect())) == Counter(plain_audit(rows))


def test_only_some_levels_are_stored(spark):
    rows = [(i, "s", "l", 1, f"{i}") for i in range(100)]
    kept = []

    def keep(df, label):
        kept.append(spark.createDataFrame(df.collect(), df.schema))
        return kept[-1]

    nodes = merkle.placed(merkle.leaves(spark.createDataFrame(rows, FIELDS)), ["payload.doc_id", "leaf"])
    forest = merkle.grow(nodes, 2, keep)
    levels = plain_tree([plain_leaf(r) for r in rows])
    stored = [[x.leaf for r in t.orderBy("block").collect() for x in r.nodes] for t in kept]
    assert stored == [levels[0], levels[2], levels[4]]
    assert forest.tops.first().top == levels[-1][0]


def test_manifest_of_an_empty_table(spark):
    made = merkle.audit(spark.createDataFrame([], FIELDS))
    assert made.count() == 0 and len(made.columns) == 7


def test_claims_are_general(spark):
    """Any field can be claimed; a wrong claim doesn't fold to the root."""
    docs = spark.createDataFrame([(i, "s", "l", i, "t") for i in range(10)], FIELDS)
    made = merkle.manifest(docs, {"n_chars": F.lit(3)})
    right = {r.doc_id for r in made.select("doc_id", (merkle.folded(F.col("claim"), "steps") == F.col("root")).alias("ok")).collect() if r.ok}
    assert right == {3}


# ---- whitening


def vectors(seed=2, n=300, d=9):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.geomspace(1, 0.05, d)) @ rng.standard_normal((d, d)) + rng.standard_normal(d)


def table(spark, found):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], *["z"] * 4) for i, v in found]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, v string, n string, component string")


def plain_whitening(found, dims, k):
    good = [(i, v) for i, v in found if v is not None and len(v) == dims and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in good], np.int64)
    listed = np.unique(x, axis=0)
    n, s = len(listed), listed.sum(0)
    centred = listed - s / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    whole = (x - s / n) @ axes / np.sqrt(values)
    out = {}
    for (i, _), row, d in zip(good, whole, ((n * x - s) ** 2).sum(1), strict=True):
        for c in range(k):
            out.setdefault((i, c + 1), []).append((n, int(d), row[c], values[c] / np.trace(covariance)))
    return out


def test_whitening(spark):
    v = vectors()
    found = list(enumerate(v)) + [(400, v[3]), (3, v[3]), (None, v[4])]
    found += [(500, None), (501, [None] * 9), (502, [*v[0][:8], float("nan")]), (503, [*v[0][:8], float("inf")]), (504, v[0][:8]), (505, [])]
    made = whitening.whiten(table(spark, found).repartition(4)).collect()
    plain = plain_whitening(found, 9, 4)
    got = defaultdict(list)
    for r in made:
        got[r.vec_id, r.component].append(r)
        assert r.identity_error < 1e-10
    assert {k: len(x) for k, x in got.items()} == {k: len(x) for k, x in plain.items()}
    signs = {c: np.sign(got[0, c][0].whitened * plain[0, c][0][2]) for c in range(1, 5)}
    for key, listed in plain.items():
        for r, (n, deviation, whitened, explained) in zip(sorted(got[key], key=lambda r: r.deviation), sorted(listed, key=lambda p: p[1]), strict=True):
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened * signs[key[1]] == pytest.approx(whitened, abs=1e-9)
            assert r.explained == pytest.approx(explained, rel=1e-9)


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, []), (3, [float("nan")])])).count() == 0
    one = whitening.whiten(table(spark, [(1, [0.5, -0.25]), (2, [0.5, -0.25])])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(table(spark, [(i, [i / 8, 1.0]) for i in range(5)])).collect()
    assert {r.component for r in flat if r.whitened is None} == {2} and len(flat) == 10
    assert {r.explained for r in flat if r.component == 1} == {1.0}


def test_large_entries_are_exact(spark):
    found = [(0, [1e6, -3e6]), (1, [2e6, 5e6]), (2, [0.0, 1.0]), (3, [3e16, 1.0])]
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in found]
    s = [sum(c) for c in zip(*x, strict=True)]
    wanted = {i: sum((4 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for (i, _), v in zip(found, x, strict=True)}
    made = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, found)).collect()}
    assert made == {i: w if w < 1 << 63 else None for i, w in wanted.items()}


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1, 1, 1, 1], [7, 7, 7, 1, 1, 0, 0], [1, 1 - 1e-9, 1e-8, 1e-13], [3], list(range(60)), [1e6, *[1.0] * 10]])
def test_divide_and_conquer(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values),) * 2))
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    found, axes = whitening.components(a)
    scale = max(values)
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-13 * scale * len(values))
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13 * max(len(values), 4)
    assert np.abs(a @ axes - axes * found).max() < 2e-13 * scale * len(values)


def test_polar_factor():
    rng = np.random.default_rng(1)
    for spread in (1, 1e-6, 1e-12):
        q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
        values = np.geomspace(1, spread, 12) * np.where(np.arange(12) % 2, 1, -1)
        u = whitening.polar(q @ np.diag(values) @ q.T)
        assert np.abs(u @ u.T - np.eye(12)).max() < 1e-12
