"""Packing, fingerprints, languages, personal data and the language model."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import classlm, fingerprint, langid, packing, pii
from seriesloom.session import shared_dir
from tests.llm.fixtures import fold, frame, hard_rows


@pytest.fixture(scope="module")
def tokenizer():
    return packing.Encoder(packing.vocabulary_path())


def whole(tokenizer, text):
    return tokenizer.plain([text])[0].tobytes() if text else b""


PIECE = st.sampled_from(["a", "Bé", " ", "  ", "\n", "\n\n", ".", ",", "'s", "1", "²", "日", "😀", "\t", "\r\n", "!?", "_", "İ", "x.y", "\x1c", "\u00a0"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, max_size=14))
def test_encoder_equals_the_tokenizer(parts):
    encoder = packing.encoder(packing.vocabulary_path())
    text = "".join(parts)
    assert list(encoder([text])) == [whole(encoder, text)]


def test_encoder_on_long_texts(tokenizer, monkeypatch):
    texts = [t for _, t in hard_rows() if t]
    wanted = [whole(tokenizer, t) for t in texts]
    assert list(tokenizer(texts)) == wanted
    monkeypatch.setattr(packing, "SLICE", 40)
    monkeypatch.setattr(packing, "MOST_KEPT", 4000)
    assert list(tokenizer(texts)) == wanted


def test_pack(spark, tokenizer):
    rows = hard_rows()
    made = packing.pack(frame(spark, rows)).collect()
    ids = [np.frombuffer(whole(tokenizer, t or "") + b"\0\0\0\0", "<u4") for _, t in rows]
    wanted = Counter()
    for (doc_id, _), x in zip(rows, ids, strict=True):
        for s in range(0, len(x), 1024):
            wanted[doc_id, s, len(x[s : s + 1024]), zlib.crc32(x[s : s + 1024].tobytes()), len(x)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in made) == wanted
    sequences = defaultdict(list)
    for r in made:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(frame(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_histogram_packing_places_everything(counts):
    patterns = packing.pack_histogram(counts, 64)
    placed = Counter()
    for n, pack in patterns:
        assert n > 0 and sum(pack) <= 64 and pack == sorted(pack, reverse=True)
        for length in pack:
            placed[length] += n
    assert placed == counts
    # two half empty ones would be one
    assert sum(n for n, p in patterns if 2 * sum(p) <= 64) <= 1


def test_fingerprints(spark):
    rows = [r for r in hard_rows() if r[0] != 70]
    made = fingerprint.fingerprints(frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    wanted = Counter()
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        wanted[doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in made) == wanted
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in made)
    long = next(r for r in made if r.doc_id == 24)
    assert long.near_edited > 0.4 > long.near_next
    by_id = {r.doc_id: r for r in made}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[8].fingerprint == by_id[9].fingerprint
    assert by_id[6].fingerprint == "" and by_id[6].near_edited == 1.0
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    alone = fingerprint.fingerprints(frame(spark, [(5, "abc" * 50)])).first()
    assert alone.near_next == 1.0


@pytest.mark.parametrize("size", [64, 65, 100, 127, 128, 141, 142, 200, 255, 5000])
@pytest.mark.parametrize("letters", [2, 20])
def test_features_cover_short_and_weak_texts(size, letters, monkeypatch):
    rng = np.random.default_rng(size)
    rank = np.arange(1001)[::-1].copy()
    rank[: fingerprint.WEAK] = 1001
    if size == 5000:
        rank[:] = 1001  # no window ranks
    data = rng.integers(97, 97 + letters, size).astype(np.uint8)
    own = fingerprint.features(data.tobytes(), rank)
    for i in range(0, size, max(1, size // 50)):
        other = data.copy()
        other[i] ^= 64
        assert fingerprint.features(other.tobytes(), rank) != own
    assert len(own) <= size // 32
    half = np.concatenate([data[: size - size // 2], rng.integers(65, 90, size // 2).astype(np.uint8)])
    assert fingerprint.likeness(fingerprint.chain(own), fingerprint.chain(fingerprint.features(half.tobytes(), rank))) < 1
    monkeypatch.setattr(fingerprint, "BLOCK", 100)
    assert fingerprint.features(data.tobytes(), rank) == own


def test_rolling_entropy_and_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 110, 3000).astype(np.uint8)
    made = fingerprint.entropies(data)
    for i in range(0, 2900, 97):
        n = np.bincount(data[i : i + 64])
        p = n[n > 0] / 64
        assert abs(-(p * np.log2(p)).sum() / 6 * 1000 - made[i]) < 1.01
    rank = np.arange(1001)[::-1].copy()
    wanted = fingerprint.features(data.tobytes(), rank)
    for block in (100, 700, 2937):
        monkeypatch.setattr(fingerprint, "BLOCK", block)
        assert fingerprint.features(data.tobytes(), rank) == wanted


def test_languages(spark):
    sample = {
        "aa": "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor",
        "bb": "zwei kleine katzen schlafen unter dem grossen tisch und wachen nicht auf",
    }
    rows = [(i, sample[k].split()[i % 12] + " " + sample[k][i % 7 :], k if i % 9 else None) for i in range(80) for k in [("aa", "bb")[i % 2]]]
    more = [(None, "123 !", "aa"), (900, None, "bb"), (901, "", None), (902, "ÿ", None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    made = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(made[i].lang_pred == ("aa", "bb")[i % 2] for i in range(80))
    assert all(made[i].held_out == (fold(i) == 0) and 0 <= made[i].score <= 1 for i in made)
    assert {made[i].lang_pred for i in (None, 900, 901)} == {"und"} and made[902].lang_pred != "und"
    assert {r.doc_id for r in langid.keep_known(docs, 0.001).collect()} == {r[0] for r in rows} | ({902} if made[902].score >= 0.001 else set())
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id > 890")).collect()} <= {"und", ""}
    assert langid.identify(frame(spark, [])).count() == 0
    assert langid.keep_known(frame(spark, hard_rows()), 0.0).columns == frame(spark, []).columns


def test_trigrams_in_slices(monkeypatch):
    text = "Über die   Brücke, 12 x ging; 𝒜b c" * 9
    wanted = dict(zip(*map(np.ndarray.tolist, langid.trigrams(text)), strict=True))
    monkeypatch.setattr(langid, "SLICE", 50)
    assert sum(wanted.values()) > 0
    made = dict(zip(*map(np.ndarray.tolist, langid.trigrams(text)), strict=True))
    assert abs(sum(made.values()) - sum(wanted.values())) <= len(text) // 25


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip"
                and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card"
                and 12 <= len(digits) <= 19
                and pii.luhn(digits)
                or kind == "phone"
                and 9 <= len(digits) <= 15
            ):
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@-_+%0159 ()\n", max_size=60))
def test_detectors_equal_the_patterns(text):
    assert pii.detect(text) == base_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to j.doe [at] mail (dot) example (dot) com now", "email", "j.doe [at] mail (dot) example (dot) com"),
        ("mail bob at mail dot example dot org!", "email", "bob at mail dot example dot org"),
        ("x joе@exаmple.com y", "email", "joе@exаmple.com"),
        ("call plus one two three four five six seven eight nine zero one please", "phone", "plus one two three four five six seven eight nine zero one"),
        ("card ４２４２ ４２４２ ４２４２ ４２４２.", "card", "４２４２ ４２４２ ４２４２ ４２４２"),
        ("ip 10\u200b.0.0\u200b.1 z", "ip", "10\u200b.0.0\u200b.1"),
    ],
)
def test_disguised_identifiers_map_back(text, kind, part):
    base, spans = pii.find_spans(text)
    assert base == base_spans(text)
    assert [(text[s:e], k) for s, e, k in spans if (s, e, k) not in base] == [(part, kind)]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("to bob@example dot com now", "email", "bob@example dot com"),
        ("host 10 dot 0 dot 0 dot 1 up", "ip", "10 dot 0 dot 0 dot 1"),
        ("mail x at y\ndot\ncom, please", "email", "x at y\ndot\ncom"),
        ("(plus one two three four five six seven eight nine)", "phone", "plus one two three four five six seven eight nine"),
    ],
)
def test_disguises_are_found_without_other_hints(text, kind, part):
    at = text.index(part)
    wanted = [(at, at + len(part), kind)]
    assert pii.find_spans(text)[1] == pii.find_spans(text + " \u2013 \u03a9")[1] == wanted


DISGUISE = st.sampled_from(
    [*"ab1 @.,;()[]<-_\n\t", "at", "AT", "arroba", "dot", "Dot", "punkt", "pun\u212at", "punto", "point", "plus", "one", "Two", "zéro", "fünf", "\u017fix"]
    + [" ", "  ", " dot ", " at ", " one two ", "\u2003", "\u200b", "\u00b5", "\u03a9", "–", "e"]
)


@settings(max_examples=3000, deadline=None)
@given(st.lists(DISGUISE, max_size=14))
def test_gate_opens_wherever_a_rule_applies(parts):
    text = "".join(parts)
    assert pii.hinted(text) or not pii.RULES.search(text)


def test_find_and_mask(spark):
    rows = [*hard_rows(), (500, "a@b.cd and 4242 4242 4242 4242, +1 (017) 555-7713; 1.2.3.4"), (501, "a@b.cd@e.fg")]
    made = pii.digest(pii.find(frame(spark, rows))).collect()
    wanted = Counter()
    for doc_id, text in rows:
        base = base_spans(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        n = Counter(k for _, _, k in base)
        wanted[doc_id, *[n[k] for k in pii.KINDS], hashlib.sha256(listed.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in made) == wanted
    masked = {r.doc_id: r.text for r in pii.mask(frame(spark, rows)).collect()}
    assert masked[500] == "<EMAIL> and <CARD>, <PHONE>; <IP>" and masked[5] is None and masked[8] == "one"
    assert pii.digest(pii.find(frame(spark, []))).count() == 0


def test_class_model(spark, monkeypatch):
    rows = hard_rows()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter()
    for i, t in rows:
        if fold(i) != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = Counter()
    for i, t in rows:
        x = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        wanted[i, fold(i) == 1, len(x), sum(counts[w] > 0 for w in x), n, round(base, 6)] += 1
    made = classlm.score(frame(spark, rows), words=50, groups=16, classes=8).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in made) == wanted
    assert all(r.score < 0 for r in made)
    assert classlm.score(frame(spark, [])).count() == 0


def test_words_outside_the_exchange_have_their_own_classes(spark):
    """Words with equal last bytes that stand at different places."""
    train = [i for i in range(2000) if fold(i) != 1]
    kind = lambda i, most: i % 3 if i % 2 else i % most  # noqa: E731  (three of each kind are frequent)
    rows = [(i, f"det n{kind(i, 90)}ab is pro v{kind(i, 80)}ab on") for i in train]
    good, bad = [i for i in range(2000) if fold(i) == 1][:2]
    rows += [(good, "det n20ab is pro v20ab on"), (bad, "det v20ab is pro n20ab on")]
    made = {r.doc_id: r for r in classlm.score(spark.createDataFrame(rows, "doc_id long, text string"), words=10, groups=4, classes=8).collect()}
    assert len(made) == len(rows) and made[good].base_score == pytest.approx(made[bad].base_score)
    assert made[good].score > made[bad].score + 1


def test_class_model_keeps_one_table_and_no_chunk_matters(spark):
    """Other partitions make other chunks; of the tables on the way only the one that the result reads stays."""
    folder = urlparse(shared_dir(spark)).path
    before = set(os.listdir(folder))
    made = classlm.score(frame(spark, hard_rows()).repartition(1), words=50, groups=16, classes=8).collect()
    left = set(os.listdir(folder)) - before
    assert [name.split("-")[0] for name in left] == ["classed"]
    again = classlm.score(frame(spark, hard_rows()).repartition(7), words=50, groups=16, classes=8).collect()
    key = lambda r: (r.doc_id or -1, r.base_score, r.score)
    for a, b in zip(sorted(made, key=key), sorted(again, key=key), strict=True):
        assert a[:5] == b[:5] and a.score == pytest.approx(b.score) and a.base_score == pytest.approx(b.base_score)


@pytest.mark.parametrize("size", [1, 2, 3, 8])
def test_words_are_summed_across_batches(size):
    """A word's rows may stand in several batches, and a word without training texts has no neighbours."""
    cell = lambda *x: np.array([*x], classlm.NEAR).tobytes()
    rows = [
        ("a", 0, 5, cell((0, 2), (7, 2))),
        ("bcd", 0, 1, cell((3, 1), (4, 1))),
        ("bcd", 1, 1, b""),
        ("bcd", 2, 9, cell((3, 4), (4, 4))),
        ("e", 1, 2, b""),
    ]
    table = np.zeros((4, 4))
    table[0, 2], table[2, 3], table[3, 0], table[3, 3] = 50, 50, 50, 200
    types = {"word": pa.binary(), "chunk": pa.int64(), "at": pa.int32(), "near": pa.binary()}
    whole = pa.RecordBatch.from_arrays([pa.array([x.encode() if isinstance(x, str) else x for x in c], t) for c, t in zip(zip(*rows), types.values())], [*types])
    batches = [whole.slice(i, size) for i in range(0, len(whole), size)]
    made = [r for batch in classlm._assign(iter(batches), table) for r in batch.to_pylist()]
    assert [(r["chunk"], r["at"], r["n"], r["tail"]) for r in made] == [(0, 5, 2, b"a"), (0, 1, 5, b"cd"), (1, 1, 5, None), (2, 9, 5, None), (1, 2, 0, b"e")]
    assert [r["cls"] for r in made[:4]] == [2, 3, 3, 3]
    by_chunk = pa.RecordBatch.from_pylist(sorted(made, key=lambda r: r["chunk"]))
    placed = [r for batch in classlm._placed(by_chunk.slice(i, size) for i in range(0, 5, size)) for r in batch.to_pylist()]
    counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), "<i8").tolist() for r in placed]
    assert [r["chunk"] for r in placed] == [0, 1, 2] and counts == [[0, 5, 0, 0, 0, 2], [0, 5, 0], [0] * 9 + [5]]


def test_neighbours_and_classes_of_rare_words():
    near = np.zeros((2, 8))
    near[0, 0] = near[0, 4 + 3] = 5  # after the end, before class 3
    near[1, 3] = near[1, 4 + 0] = 5
    table = np.zeros((4, 4))
    table[0, 2], table[2, 3], table[3, 0] = 50, 50, 50
    assert classlm.best_classes(near, table)[0] == 2
    table[3, 3] = 200
    assert classlm.best_classes(near, table).tolist() == [2, 3]


def test_class_model_is_a_distribution_and_exchange_climbs():
    rng = np.random.default_rng(0)
    nodes, groups = 12, 3
    pairs = rng.integers(0, 30, (nodes, nodes))
    node = {b"": 0} | {b"w%d" % i: i for i in range(1, nodes - groups)}

    def likelihood(own):
        hot = np.zeros((nodes, own.max() + 1))
        hot[np.arange(nodes), own] = 1
        t = hot.T @ pairs @ hot
        f = classlm._xlogx
        return f(t).sum() - f(t.sum(1)).sum() - f(t.sum(0)).sum()

    start = classlm.exchange(pairs, 5, 0)
    own = classlm.exchange(pairs, 5, 20)
    assert likelihood(own) > likelihood(start) and own[0] == 0 and (own[1:] > 0).all()
    model = classlm.Model(node, own, pairs, [1] * groups, [1] * groups)
    assert np.allclose((10**model.after).sum(1), 1)
    total = np.bincount(own, 10**model.inside)
    assert np.allclose(total[np.unique(own)], 1)


def test_vectors_in_blocks(monkeypatch):
    """Sums do not depend on blocks, and many letters need no more than a block of vectors."""
    text = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(6000)) + " plain words here"
    keys, counts = langid.trigrams(text)
    weights = np.vstack([counts, counts[::-1]]).astype(np.float32)
    space = langid.Space(64, 1)
    whole = weights.astype(np.float64) @ space.of_trigrams(keys).astype(np.float64)
    for block in (langid.BLOCK, 100):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "MOST_LETTERS", 32_768 if block > 100 else 300)
        small = langid.Space(64, 1, 300 if block == 100 else 16_384)
        assert np.array_equal(small.bundles(keys, weights), whole)
        assert len(small.vectors) <= small.most and len(small.letters) <= langid.MOST_LETTERS


def test_texts_of_many_letters_are_bundled_alone(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 900).tolist())) for _ in range(70)] + ["the plain words"] * 3
    docs = spark.createDataFrame([(i, t, "zh" if i < 70 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    prototypes = langid.learn(docs)
    assert set(prototypes) == {"zh", "en"}
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, prototypes).collect()}
    assert got == {i: "zh" if i < 70 else "en" for i in range(73)}


def test_kept_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MOST_KEPT", 100_000)
    encoder = packing.Encoder(packing.vocabulary_path())
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(100))
        assert list(encoder([text])) == [whole(tokenizer, text)]
    assert packing.PER_WORD * (len(encoder.cache) + len(encoder.before)) < 150_000
