"""Queries over whole tables, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import (
    classlm,
    decontaminate,
    fingerprint,
    jaccard,
    langid,
    merkle,
    packing,
    pii,
    substring_dedup,
    suffix_dedup,
    token_counts,
    urls,
    whitening,
)
from seriesloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def url_sql() -> str:
    """The rules, the two models, the threshold and the verdicts of ``urls`` in SQL."""
    k = urls.ORDER
    ordered = sorted(urls.RULES, key=lambda x: -len(x[0]) - len(x[1]))
    when = lambda pick: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick((h, p, v))}'" for h, p, v in ordered
    )
    levels = []
    for i in range(k + 1):
        below = f"JOIN l{i - 1} ON l{i - 1}.gram = substr(h.gram, 2)" if i else ""
        last = (f"l{i - 1}.good_p", f"l{i - 1}.bad_p") if i else (f"1e0/{urls.ALPHABET}", f"1e0/{urls.ALPHABET}")
        mixed = ", ".join(
            f"CASE WHEN {c}_n > 0 THEN ({c} + {c}_t * {q}) / ({c}_n + {c}_t) ELSE {q} END AS {c}_p" for c, q in zip(("good", "bad"), last, strict=True)
        )
        levels.append(
            f"""h{i} AS (SELECT substr(gram, {k + 1 - i}) AS gram, sum(good)::DOUBLE AS good, sum(bad)::DOUBLE AS bad FROM g GROUP BY 1),
c{i} AS (SELECT substr(gram, 1, {i}) AS context, sum(good) AS good_n, sum(bad) AS bad_n, count(*) FILTER (good > 0) AS good_t,
         count(*) FILTER (bad > 0) AS bad_t FROM h{i} GROUP BY 1),
l{i} AS (SELECT h.gram, {mixed} FROM h{i} h JOIN c{i} ON c{i}.context = substr(h.gram, 1, {i}) {below})"""
        )
    half, q = urls.MOST_BINS // 2, ",\n"
    return f"""
WITH s AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), {LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT *, CASE {when(lambda x: x[0] + x[1])} END AS rule, CASE {when(lambda x: x[2])} END AS said FROM p),
t AS (SELECT url, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad,
      repeat(chr(2), {k}) || translate(url, {LOWER}) || chr(3) AS m FROM r GROUP BY url),
e AS (SELECT url, good, bad, substr(m, i, {k + 1}) AS gram FROM (SELECT *, unnest(range(1, length(m) - {k} + 1)) AS i FROM t)),
g AS (SELECT gram, sum(good) AS good, sum(bad) AS bad FROM e GROUP BY gram),
{q.join(levels)},
x AS (SELECT url, good, bad, round(sum(ln(good_p) - ln(bad_p)) / count(*), 9) AS score FROM e JOIN l{k} USING (gram) GROUP BY ALL),
b AS (SELECT greatest(-{half}, least({half}, floor(score / {urls.BIN}))) AS bin, sum(good) AS good, sum(bad) AS bad FROM x GROUP BY 1),
y AS (SELECT bin, round(coalesce(sum(bad) OVER w, 0) / sum(bad) OVER () - coalesce(sum(good) OVER w, 0) / sum(good) OVER (), 9) AS gain
      FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT bin * {urls.BIN} AS least FROM y WHERE gain IS NOT NULL ORDER BY gain DESC, bin DESC LIMIT 1)
SELECT page_id, r.host, r.path, rule, coalesce(said, CASE WHEN score >= coalesce((SELECT least FROM z), score) THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN x ON r.url = x.url
"""


oracle("op3_url_filter", url_sql())


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from four of five folds."""
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without windows that start earlier."""
    made = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without strings that start earlier."""
    made = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
oracle(
    "op7_decontamination",
    f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM bw),
lens AS (SELECT DISTINCT n FROM grams),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN grams ON dw.n = grams.n AND array_to_string(w[i:i+dw.n-1], ' ') = g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
)


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query
def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and class model scores of every document."""
    return classlm.score(table(spark, sf_dir, "documents"))


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard.join(table(spark, sf_dir, "documents"))


oracle(
    "op10_ngram_jaccard",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, least(5, len(w)) AS n, w FROM d),
s AS (SELECT doc_id, CASE WHEN n = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))) END AS grams FROM g),
c AS (SELECT grams, min(doc_id) AS cls, count(*) AS docs, len(grams) AS size FROM s GROUP BY grams),
e AS (SELECT cls, size, unnest(grams) AS gram FROM c),
p AS (SELECT a.cls AS x, b.cls AS y, a.size + b.size - count(*) AS either, count(*) AS both
      FROM e a JOIN e b ON a.gram = b.gram AND a.cls < b.cls GROUP BY a.cls, b.cls, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT cls AS a, cls AS b FROM c UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
n AS (SELECT x, sum(docs) AS linked FROM l JOIN c ON c.cls = l.y GROUP BY x)
SELECT doc_id, class_id, c.cls AS copy_id, CAST(docs - 1 + coalesce(linked, 0) AS BIGINT) AS n_links
FROM s JOIN c ON s.grams = c.grams JOIN k ON k.a = c.cls LEFT JOIN n ON n.x = c.cls
""",
)


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of every usable embedding, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def merkle_sql() -> str:
    """Leaves, levels, proofs and folded roots, with the crc32 bit by bit."""

    def leaf(**other: str) -> str:
        fields = [other.get(c, c) for c in merkle.FIELDS]
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in fields) + ")"

    bits = "[((ord(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) >> (i % 8)::INT) & 1)::BIGINT for i in range(8 * strlen(doc_id::VARCHAR))]"
    state = f"list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384::BIGINT))"
    level = "tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)"

    def sides(table: str) -> str:
        return f"""SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
       coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
FROM {table} a JOIN {table} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL"""

    return f"""
WITH RECURSIVE f AS (SELECT *, {state} & 1 = 1 AS even FROM documents),
g AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf()} AS h, {leaf(text="(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")} AS c FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM g),
up AS (SELECT tree, 0 AS lvl, pos, h, n FROM d UNION ALL SELECT {level} FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3),
tops AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
above AS (SELECT '' AS tree, 0 AS lvl, pos, subroot AS h, n FROM tops UNION ALL SELECT {level} FROM above WHERE n > 1 GROUP BY tree, lvl, pos // 3),
x AS ({sides("up")}),
y AS ({sides("above")}),
s AS (SELECT d.tree, d.pos, x.lvl, l, r FROM d JOIN x ON x.tree = d.tree AND x.pos = d.pos // pow(3, x.lvl)::BIGINT
      UNION ALL SELECT d.tree, d.pos, 100 + y.lvl, l, r FROM d JOIN tops ON tops.source = d.tree JOIN y ON y.pos = tops.pos // pow(3, y.lvl)::BIGINT),
k AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY lvl) AS step FROM s),
w AS (SELECT tree, pos, 0::BIGINT AS step, c AS h FROM d
      UNION ALL SELECT w.tree, w.pos, k.step, sha256(l || w.h || r) FROM w JOIN k ON k.tree = w.tree AND k.pos = w.pos AND k.step = w.step + 1),
folded AS (SELECT tree, pos, arg_max(h, step) AS folded_root FROM w GROUP BY ALL),
proof AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY step) AS proof FROM k GROUP BY ALL)
SELECT d.doc_id, d.h AS leaf, subroot, above.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = above.h AS verified
FROM d JOIN tops ON tops.source = d.tree JOIN above ON above.n = 1 JOIN folded ON folded.tree = d.tree AND folded.pos = d.pos
LEFT JOIN proof ON proof.tree = d.tree AND proof.pos = d.pos
"""


oracle("op13_merkle", merkle_sql())
