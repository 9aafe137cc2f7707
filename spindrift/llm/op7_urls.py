"""URL filters in DataFrame functions only: rules first, then a character language-model ratio.

Two Markov models of variable order (up to two preceding characters), one of URLs that the rules allow and one of
those that they block, are smoothed by Witten-Bell: an order blends with the next lower one by the number of distinct
followers of its context, and a context never seen falls back entirely. A URL's score is the difference of its log
likelihoods divided by its length. The threshold is calibrated on all ruled URLs to the least sum of error rates.

Characters are mapped to 32 symbols, so the models are one array of 32**3 log ratios whatever the input's size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, texts

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-~^"
_BASE = len(SYMBOLS)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Model:
    """Log ratios by 32 * (32 * a + b) + c, and the threshold below which a URL is blocked."""

    ratios: tuple[float, ...]
    threshold: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    own = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(own, _URL, 1), _UPPER, _LOWER), F.regexp_extract(own, _URL, 2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict; of the rules that fit, the longest; null if none fits."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def _codes(url: Column) -> Column:
    """Trigram codes of a URL after its scheme, with two marks before and one behind."""
    body = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    plain = F.regexp_replace(F.translate(body, _UPPER + "123456789_", _LOWER + "000000000-"), r"[^a-z0./-]", "~")
    numbers = F.transform(F.split(F.concat(F.lit("^^"), plain, F.lit("^")), ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    return F.element_at(F.transform(F.array(numbers), lambda n: F.transform(F.sequence(F.lit(1), F.size(n) - 2), lambda i: (F.element_at(n, i) * _BASE + F.element_at(n, i + 1)) * _BASE + F.element_at(n, i + 2))), 1)


def _ratios(trained: DataFrame) -> tuple[float, ...]:
    """From rows (accepted: int, code): counts by class and code, then smoothed over the whole grid of codes."""
    spark = trained.sparkSession
    counts = trained.groupBy("accepted", "code").agg(F.count(F.lit(1)).alias("n"))
    size = _BASE**3
    grid = spark.range(2 * size).select((F.col("id") / size).cast("int").alias("accepted"), (F.col("id") % size).cast("int").alias("code"))
    rows = grid.join(counts, ["accepted", "code"], "left").select("accepted", "code", F.coalesce("n", F.lit(0)).alias("n"), F.expr(f"code div {_BASE}").alias("ab"), F.expr(f"code % {_BASE * _BASE}").alias("bc"), F.expr(f"code div {_BASE} % {_BASE}").alias("b"), (F.col("code") % _BASE).alias("c"))
    over = lambda *by: Window.partitionBy("accepted", *by)
    rows = rows.select("*", F.sum("n").over(over("ab")).alias("n2"), F.sum((F.col("n") > 0).cast("int")).over(over("ab")).alias("t2"), F.sum("n").over(over("bc")).alias("c1"), F.sum("n").over(over("b")).alias("n1"), F.sum("n").over(over("c")).alias("c0"), F.sum("n").over(over()).alias("n0"))
    first = (F.col("code") < _BASE * _BASE).cast("int")  # a = 0: one row for each (b, c)
    rows = rows.select("*", F.sum((F.col("c1") > 0).cast("int") * first).over(over("b")).alias("t1"), F.sum((F.col("c0") > 0).cast("int") * (F.col("code") < _BASE).cast("int")).over(over()).alias("t0"))
    blend = lambda c, n, t, lower: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * lower) / (F.col(n) + F.col(t))).otherwise(lower)
    p = blend("n", "n2", "t2", blend("c1", "n1", "t1", blend("c0", "n0", "t0", F.lit(1.0 / _BASE))))
    logs = rows.select("code", F.when(F.col("accepted") == 1, F.log(p)).otherwise(-F.log(p)).alias("part")).groupBy("code").agg(F.sum("part").alias("ratio"))
    return tuple(logs.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "ratio"))), lambda x: x["ratio"]).alias("r")).first()["r"])


def _score(url: Column, ratios: tuple[float, ...]) -> Column:
    table_ = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    return F.element_at(F.transform(F.array(_codes(url)), lambda codes: F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.element_at(table_, c + 1)) / F.size(codes)), 1)


def fit(pages: DataFrame, rules=RULES) -> Model:
    """Models and threshold from all of pages (url) that a rule fits. Without URLs of both kinds nothing is blocked."""
    host, path = host_and_path(F.col("url"))
    labelled = pages.select("url", (ruled(host, path, rules)[1] == "allow").cast("int").alias("accepted")).filter("accepted IS NOT NULL")
    ratios = _ratios(labelled.select("accepted", F.explode(_codes(F.col("url"))).alias("code")))
    bins = labelled.select("accepted", F.floor(_score(F.col("url"), ratios) * 1000).alias("bin")).groupBy("bin").agg(F.sum("accepted").alias("good"), F.sum(1 - F.col("accepted")).alias("bad"))
    bins = checkpointed(bins)
    total = bins.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total["good"] or not total["bad"]:
        return Model(ratios, -math.inf)
    before = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.lag("bin").over(Window.partitionBy(F.lit(0)).orderBy("bin")) + 1, F.col("bin"))
    errors = bins.select("bin", gap.alias("gap"), F.coalesce(F.sum("good").over(before), F.lit(0)).alias("lost"), F.coalesce(F.sum("bad").over(before), F.lit(0)).alias("caught"))
    best = errors.select("bin", "gap", (F.col("lost") / total["good"] + 1 - F.col("caught") / total["bad"]).alias("error")).orderBy("error", "bin").first()
    return Model(ratios, (best["bin"] + best["gap"]) / 2000)  # the middle of the empty bins below


def verdicts(pages: DataFrame, rules=RULES, model: Model | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages (page_id, url).

    A null url, or one without '://', has an empty host and path, and no rule fits; the models judge the whole of it.
    Repeated rows and null ids give a row each. An empty table gives no rows.
    """
    model = model or fit(pages, rules)
    host, path = host_and_path(F.col("url"))
    rule, verdict = ruled(host, path, rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"), _score(F.col("url"), model.ratios).alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") < F.lit(model.threshold), "block").otherwise("allow")).alias("verdict"), "score")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(texts(table(spark, sf_dir, "pages"), "page_id", "url"))
