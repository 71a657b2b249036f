"""A small table with the hard cases, and plain versions of the operators."""

import random
import zlib

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score string, cls string, key string, sid string, tk string, start string, range string, root string, tail long"
)


def words(rng, n, vocabulary=None):
    vocabulary = vocabulary or [f"w{i}" for i in range(400)]
    return [rng.choice(vocabulary) for _ in range(n)]


def hard_rows(seed=3):
    """(doc_id, text): copies, near copies, shared passages, nulls, blanks, periodic and long texts."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    base = words(rng, 120)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (None, " ".join(base))]
    near = list(base)
    near[50] = "changed"
    rows += [(3, " ".join(near)), (4, " ".join(near[:-1]))]
    rows += [(5, None), (6, ""), (7, "  \n "), (8, "one"), (9, "one"), (10, "one two three"), (None, None), (11, "7 8 9 !")]
    rows += [(12 + i, " ".join([*words(rng, 10 + 7 * i), passage, *words(rng, 5)])) for i in range(4)]
    rows += [(20, "ab " * 90), (21, "x" * 400), (22, "x" * 150 + "y" + "x" * 150), (23, "é" * 130 + " ß " + "é" * 130)]
    rows += [(24, " ".join(words(rng, 6000))), (25, "\x1c odd\u00a0blank\u2003text\r\n\r\n end ")]
    rows += [(30 + i, " ".join(words(rng, rng.randint(1, 80)))) for i in range(30)]
    rows += [(70, " ".join(words(rng, 40))), (70, " ".join(words(rng, 40)))]  # two texts with one id
    return rows


def frame(spark, rows):
    """The rows with clashing extra columns."""
    full = [(i, t, "en" if n % 3 else None, "s", len(t or ""), *["z"] * 8, n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def without_repeats(rows, split, k):
    """{(doc_id, text): mask of covered units}, windows compared from the smallest id on."""
    import xxhash

    order = lambda r: (-(1 << 63) if r[0] is None else r[0], xxhash.xxh3_128_digest((r[1] or "").encode()))
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=order):
        units = split((text or "").encode())
        mask = [False] * len(units)
        for s in range(len(units) - k + 1):
            w = bytes(units[s : s + k]) if isinstance(units, bytes) else tuple(units[s : s + k])
            if w in seen:
                mask[s : s + k] = [True] * k
            seen.add(w)
        out[doc_id, text] = (units, mask)
    return out


def grams(text, n=5):
    w = (text or "").lower().encode().split()
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def jaccard_groups(rows):
    """Per row (class_id, n_links) by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (common and 5 * common >= 4 * len(sets[i] | sets[j])):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return [(ids.get(find(i)), links[i]) for i in range(len(rows))]
