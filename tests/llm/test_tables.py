"""URL filter, decontamination, the registered queries and the pipeline."""

import math
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from seriesloom.llm import decontaminate, pii, urls
from seriesloom.llm.queries import ORACLE, QUERIES
from tests.helpers import normal
from tests.llm.fixtures import frame, hard_rows, jaccard_groups


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def plain_hits(rows, items):
    grams = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    out = Counter()
    for doc_id, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out[doc_id, len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    rows = hard_rows()
    passage = rows[14][1].split()
    items = [(1, " ".join(passage[12:40])), (2, "One, TWO three!"), (3, None), (4, ""), (10, " ".join(passage[20:33])), (11, "É é"), (12, "one")]
    rows += [(600, "É é ÉÉ"), (601, "é É"), (602, "x one, two. three y one two three")]
    made = decontaminate.scan(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert made.columns == [*frame(spark, []).columns, "__found"]
    got = Counter((r.doc_id, r.f.n_words, r.f.n_hit, tuple(r.f["items"])) for r in made.select("doc_id", F.col("__found").alias("f")).collect())
    assert got == plain_hits(rows, items)


def test_long_texts_take_time_in_proportion(spark):
    """Neither a window nor a hit may go through the whole text again."""
    listed = [f"w{i * 7919 % 20011}" for i in range(20_000)]
    items = spark.createDataFrame([(1, " ".join(listed[5000:9000])), (2, " ".join(listed[8990:9003]))], "item_id long, text string")
    docs = frame(spark, [(1, "; ".join(listed)), (2, "W0 " * 20_000)])
    begun = time.monotonic()
    made = {r.doc_id: r for r in decontaminate.digest(decontaminate.scan(docs, items)).collect()}
    assert time.monotonic() - begun < 30
    assert (made[1].n_words, made[1].n_hit, made[1].n_items, made[1].contaminated) == (20_000, 4003, 2, True)
    assert (made[2].n_words, made[2].n_hit, made[2].contaminated) == (20_000, 0, False)


def test_hashes_of_windows(spark):
    """Equal windows have equal hashes wherever they stand, for all lengths; others differ."""
    rows = [("a b a b a b c a b a b a b c d e f g h i j k l",), ("x a b a b a b c d",), ("a",), ("",), (None,)]
    plain = spark.createDataFrame(rows, "text string").select(decontaminate.words("text").alias("w"))
    hashed = decontaminate.with_hashes(plain, "w", range(1, 14), "h")
    made = hashed.select("w", *[decontaminate.whole_windows(f"h{n}", n).alias(f"h{n}") for n in range(1, 14)]).collect()
    for n in range(1, 14):
        pairs = {(tuple(r.w[i : i + n]), h) for r in made for i, h in enumerate(r[f"h{n}"])}
        windows = {tuple(r.w[i : i + n]) for r in made for i in range(len(r.w) - n + 1)}
        assert len({h for _, h in pairs}) == len(pairs) and {w for w, _ in pairs} == windows
        assert all(len(r[f"h{n}"]) == max(0, len(r.w) - n + 1) for r in made)


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, hard_rows())
    assert {r.n_hit for r in decontaminate.digest(decontaminate.scan(docs, items)).collect()} == {0}
    assert decontaminate.remove(docs.limit(0), items).count() == 0
    kept = decontaminate.remove(docs, items)
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_url_parts_and_rules(spark):
    listed = [
        ("https://WWW.Example.com/en/a?x", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/#b", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com", "example.com", "", None, None),
        ("x://b.com/q?a://c.net/es/", "b.com", "/q", "com/", "allow"),
        ("http://notcom/", "notcom", "/", None, None),
        ("http://a.net/fr/x", "a.net", "/fr/x", "net/fr/", "block"),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://ÉA.com/a", "Éa.com", "/a", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, x[0], "h", "s") for i, x in enumerate(listed)], "page_id long, url string, host string, score string")
    made = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(listed):
        assert (made[i].host, made[i].path, made[i].rule) == (host, path, rule)
        assert made[i].verdict == verdict or verdict is None and made[i].verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("page_id in (2, 6, 7)")).collect()} == {"allow"}


def test_whole_urls_are_scored(spark):
    """What speaks for or against a URL may stand in its scheme, query or fragment alone; letters' case does not matter."""
    good = [f"https://{h}.com/p{i}?ref=alpha#top" for i, h in enumerate("abcdefgh")]
    bad = [f"http://{h}.net/es/p{i}?ref=omega#end" for i, h in enumerate("abcdefgh")]
    asked = ["https://x.org/p?ref=alpha#top", "https://x.org/p?REF=Alpha#TOP", "http://x.org/p?ref=omega#end", "http://x.org/p?ref=omega#end"]
    pages = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id long, url string")
    made = urls.judge(pages).collect()
    assert len(made) == len(good) + len(bad) + len(asked)
    last = sorted((r for r in made if r.page_id >= 16), key=lambda r: r.page_id)
    assert {(r.host, r.path, r.rule) for r in last} == {("x.org", "/p", None)}
    assert last[0].score == last[1].score > 0 > last[2].score == last[3].score
    assert [r.verdict for r in last[2:]] == ["block", "block"]


def test_models_of_urls(spark):
    """Ratios equal a plain Witten-Bell mixture."""
    good, bad = ["aab", "aac", "ab"], ["zzb", "za", "aa"]
    rows = [(s, int(s in good), int(s in bad)) for s in good + bad + ["xy"]]
    table = spark.createDataFrame(rows, "s string, good long, bad long")
    counts = table.select("good", "bad", F.explode(urls.grams(F.col("s"))).alias("gram")).groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    made = {r.gram: r.ratio for r in urls.model(counts).collect()}

    def probability(texts, gram):
        seen = Counter()
        for t in texts:
            m = urls.START * 4 + t + urls.STOP
            for i in range(len(m) - 4):
                for k in range(5):
                    seen[m[i + 4 - k : i + 5]] += 1
        p = 1 / urls.ALPHABET
        for k in range(5):
            tail = gram[4 - k :]
            around = [n for g, n in seen.items() if len(g) == k + 1 and g[:-1] == tail[:-1]]
            if around:
                p = (seen[tail] + len(around) * p) / (sum(around) + len(around))
        return p

    for gram, ratio in made.items():
        assert ratio == pytest.approx(math.log(probability(good, gram)) - math.log(probability(bad, gram)), abs=1e-9)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    assert normal(QUERIES[name](spark, data).toPandas()) == normal(con.execute(ORACLE[name]).df())


def test_queries_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    step = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, current, data)
        assert made.schema.names == docs.schema.names and dict(made.dtypes) == dict(docs.dtypes)
        current = spark.createDataFrame(made.collect(), docs.schema)
        step[name] = {r.doc_id: r for r in current.collect()}
    everything = {r.doc_id: r for r in docs.collect()}
    assert set(step["language"]) == {i for i, r in everything.items() if any(c.isalpha() for c in r.text or "")}
    before = [(i, r.text) for i, r in step["language"].items()]
    assert set(step["near_duplicates"]) == {g for g, _ in jaccard_groups(before)}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    hits = plain_hits([(i, r.text) for i, r in step["near_duplicates"].items()], items)
    assert set(step["decontamination"]) == {i for (i, n, h, _) in hits if not (h and 20 * h >= n)}
    for i, r in step["personal_data"].items():
        was = step["decontamination"][i]
        assert r.n_chars == len(r.text) and (r.text != was.text) == bool(pii.find_spans(was.text)[1])
    packed = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in packed} == set(step["personal_data"])
