"""URL filter: two character Markov models of variable order, one of accepted and one of rejected URLs.

Rules on hosts and paths label the URLs they fit. From those, each model counts which character
follows which context of up to four characters; a probability mixes the orders by Witten-Bell
weights, so that rare contexts lean on shorter ones. A URL's score is the log-likelihood difference
of the two models, divided by its number of characters; scheme, query and fragment are learnt from and
scored like host and path, A-Z lower-cased. The threshold is the one that separates the
labelled URLs best (largest sum of the two hit rates over a histogram of scores). Only DataFrame
functions are used.

Counts are made over distinct five-character strings, whose number depends on the characters in use
and hardly on the number of URLs; equal URLs are scored once.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and is judged
by the models like any other; where one of the two classes has no URL at all, the models allow; ids
may repeat or be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import written

ORDER, ALPHABET = 4, 256
BIN, MOST_BINS = 0.01, 4000
#: Rows of the model (about 40 bytes each) up to which it is broadcast.
MOST_BROADCAST = 500_000
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
START, STOP = "\x02", "\x03"


def parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    c = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(c, "://")
    rest = F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda x: len(x[0]) + len(x[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(text: Column, order: int = ORDER) -> Column:
    """Every character of a text behind its context; the end is a character too."""
    marked = F.concat(F.lit(START * order), text, F.lit(STOP))
    return F.transform(F.sequence(F.lit(1), F.length(marked) - order), lambda i: F.substring(marked, i, order + 1))


def model(counts: DataFrame, order: int = ORDER, alphabet: int = ALPHABET) -> DataFrame:
    """gram and ratio (log of accepted over rejected) from ``gram, good, bad`` counts."""
    lower = None
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        here = counts.groupBy(tail.alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        here = here.withColumn("context", F.substring("gram", 1, k))
        around = here.groupBy("context").agg(
            F.sum("good").alias("good_n"),
            F.sum("bad").alias("bad_n"),
            F.count_if(F.col("good") > 0).alias("good_t"),
            F.count_if(F.col("bad") > 0).alias("bad_t"),
        )
        both = here.join(around, "context")
        if lower is None:
            both = both.withColumns({"good_p": F.lit(1.0 / alphabet), "bad_p": F.lit(1.0 / alphabet)})
        else:
            both = both.join(lower, F.substring("gram", 2, k) == F.col("shorter"))
        mixed = {
            c: F.when(F.col(f"{c}_n") > 0, (F.col(c) + F.col(f"{c}_t") * F.col(f"{c}_p")) / (F.col(f"{c}_n") + F.col(f"{c}_t"))).otherwise(F.col(f"{c}_p"))
            for c in ("good", "bad")
        }
        lower = both.select(F.col("gram").alias("shorter"), mixed["good"].alias("good_p"), mixed["bad"].alias("bad_p"))
    return lower.select(F.col("shorter").alias("gram"), (F.ln("good_p") - F.ln("bad_p")).alias("ratio"))


def threshold(labelled: DataFrame) -> DataFrame:
    """One row ``least``: the score from which on a URL is allowed. ``labelled``: score, good, bad."""
    half = MOST_BINS // 2
    bins = labelled.groupBy(F.greatest(F.lit(-half), F.least(F.lit(half), F.floor(F.col("score") / BIN))).alias("bin")).agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )
    every = Window.partitionBy()  # MOST_BINS + 1 rows at most
    below = Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.sum("bad").over(every) - F.coalesce(F.sum("good").over(below), F.lit(0)) / F.sum("good").over(every)
    usable = (F.sum("good").over(every) > 0) & (F.sum("bad").over(every) > 0)
    rated = bins.select("bin", F.when(usable, F.round(gain, 9)).alias("gain"))
    return rated.where("gain is not null").agg(F.max_by("bin", F.struct("gain", F.col("bin"))).alias("bin")).select((F.col("bin") * BIN).alias("least"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row. Runs jobs."""
    host, path = parts("url")
    split = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("said"))
    texts = ruled.groupBy("url").agg(
        F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad")
    )
    text = F.translate("url", string.ascii_uppercase, string.ascii_lowercase)
    counts = texts.select("good", "bad", F.explode(grams(text)).alias("gram")).groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ratios = written(model(written(counts, "grams")), "ratios")
    if ratios.count() <= MOST_BROADCAST:
        ratios = F.broadcast(ratios)
    scored = (
        texts.select("url", "good", "bad", F.explode(grams(text)).alias("gram"))
        .join(ratios, "gram")
        .groupBy("url", "good", "bad")
        .agg(F.round(F.sum("ratio") / F.count("*"), 9).alias("score"))
    )
    scored = written(scored, "scores")
    least = threshold(scored).first().least
    judged = F.when(F.col("score") >= F.lit(least), "allow").otherwise("block") if least is not None else F.lit("allow")
    both = ruled.join(scored.select("url", "score"), "url")
    return both.select("page_id", "host", "path", "rule", F.coalesce("said", judged).alias("verdict"), "score")
