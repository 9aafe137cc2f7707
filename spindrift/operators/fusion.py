"""Evidence fusion: signals of a query and a candidate to a score, flags and a verdict.

Everything is Column arithmetic over one row of signals, so Catalyst keeps it within one generated stage. Flags are
declared as data: a flag is an all-of list of conditions, some of which are any-of lists. Percent scores run 0 to 100.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signals and what an absent one counts as.
SIGNALS = ("p", "d", "roi", "hist", "orb", "ai", "copy", "geometry", "inliers", "ratio", "coverage_q", "coverage_c", "ssim", "overlap")

# Fixed values of the rules: (signal, least value). A nested tuple is an any-of list.
WEIGHTS = {"p": 0.24, "d": 0.08, "roi": 0.10, "hist": 0.07, "orb": 0.15, "ai": 0.06, "copy": 0.30}
INDEPENDENT = (("p", 92), ("d", 90), ("roi", 90), ("orb", 75), ("geometry", 84), ("copy", 82))
GEOM_STRUCTURAL = (("geometry", 90), ("inliers", 16), ("ratio", 0.50), ("sane", 1), ("cov_min", 0.025), ("cov_max", 0.10))
GEOM_MID = (("geometry", 84), ("inliers", 9), ("ratio", 0.40), ("sane", 1), ("cov_min", 0.015), ("cov_max", 0.065))
ULTRA_GEOMETRY = (("geometry", 96), ("inliers", 24), ("ratio", 0.60), ("sane", 1), ("cov_min", 0.055), ("cov_max", 0.18), ("ssim", 62), ("overlap", 0.10))
STRONG_GEOMETRY = (*GEOM_STRUCTURAL, (("copy", 68), ("p", 88), ("roi", 88)))
STRONG_HASH = (("rich", 1), ("p", 98), (("d", 95), ("roi", 95)), ("hist", 82), (("copy", 72), ("orb", 72), ("geometry", 82)))
STRONG_COMBO = (("rich", 1), ("p", 92), ("orb", 72), (("copy", 66), ("geometry", 72)), ("independent", 3))
STRONG_COPY = (("rich", 1), ("copy", 84), (("geometry", 72), ("p", 84), ("roi", 84), ("orb", 66)))
VERY_STRONG_COPY = (("rich", 1), ("copy", 94), (("p", 78), ("roi", 78), ("orb", 55), ("geometry", 60)))
LOW_INFO_SAFE = (("poor", 1), ("p", 99), ("d", 97), ("hist", 98), ("copy", 94), ("geometry", 70))
HASH_SIGNAL = ((("p", 88), ("roi", 88)), ("d", 76))
APPEARANCE_SIGNAL = (("ssim", 46), ("overlap", 0.10), ("hist", 68))


@dataclass(frozen=True)
class FusionPolicy:
    similar: float = 85.0
    auto: float = 90.0
    hash_direct: float = 96.0
    step: float = 0.25
    top: float = 99.6


def _at_least(columns: dict[str, Column], rule) -> Column:
    if isinstance(rule[0], str):
        return columns[rule[0]] >= rule[1]
    return reduce(lambda a, b: a | b, [_at_least(columns, r) for r in rule])


def _all(columns: dict[str, Column], rules) -> Column:
    return reduce(lambda a, b: a & b, [_at_least(columns, r) for r in rules])


def fuse(signals: DataFrame, policy: FusionPolicy = FusionPolicy()) -> DataFrame:
    """signals with base, score, strong, suspect, learn_safe and independent.

    Columns: SIGNALS, sane and low_info (boolean). A missing or null signal is 0, a missing flag false.
    """
    have = set(signals.columns)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    truth = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    plain = {c: value(c) for c in SIGNALS}
    plain |= {"sane": truth("sane").cast("int"), "poor": truth("low_info").cast("int"), "rich": (~truth("low_info")).cast("int")}
    plain |= {"cov_min": F.least(plain["coverage_q"], plain["coverage_c"]), "cov_max": F.greatest(plain["coverage_q"], plain["coverage_c"])}
    # each derived value is a column of its own, so that no expression is worked out twice
    rows = signals.withColumns({f"_{k}": v for k, v in plain.items()})
    c = {k: F.col(f"_{k}") for k in plain}
    rows = rows.withColumn("independent", sum((_at_least(c, r).cast("int") for r in INDEPENDENT), F.lit(0)))
    c["independent"] = F.col("independent")
    flags = {"ultra": ULTRA_GEOMETRY, "geom": STRONG_GEOMETRY, "hash": STRONG_HASH, "combo": STRONG_COMBO, "copyflag": STRONG_COPY, "verycopy": VERY_STRONG_COPY, "lowsafe": LOW_INFO_SAFE, "mid": GEOM_MID, "hashsig": HASH_SIGNAL, "looksig": APPEARANCE_SIGNAL}
    rows = rows.withColumns({f"_f_{k}": _all(c, v) for k, v in flags.items()})
    f = {k: F.col(f"_f_{k}") for k in flags}
    rich = c["rich"] == 1
    any_strong = f["ultra"] | f["geom"] | f["hash"] | f["combo"] | f["copyflag"] | f["verycopy"] | f["lowsafe"]
    strong = any_strong & (rich | f["ultra"] | f["geom"] | f["lowsafe"])
    base = sum((w * c[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    none = F.lit(0.0)
    copy_lift = (
        F.when(f["copyflag"], 90 + F.least(F.lit(9.3), F.greatest(none, c["copy"] - 82) * 0.62 + F.greatest(none, c["geometry"] - 76) * 0.08))
        .when(f["verycopy"], 92 + F.least(F.lit(7.0), (c["copy"] - 91) * 0.75))
        .when(c["copy"] >= 70, F.least(F.lit(policy.auto - policy.step), 82 + (c["copy"] - 70) * 0.48))
        .otherwise(none)
    )
    hash_lift = F.when(f["hash"], 90 + (c["p"] - policy.hash_direct) * 1.5).otherwise(none)
    low_lift = F.when(f["lowsafe"], 92 + F.least(F.lit(5.0), (c["hist"] - 97) * 0.6 + (c["copy"] - 90) * 0.25)).otherwise(none)
    copy_signal, local_signal = c["copy"] >= 80, f["mid"] | (c["orb"] >= 72)
    suspect = F.col("strong") | (rich & ((copy_signal & (f["hashsig"] | local_signal | f["looksig"])) | (local_signal & f["hashsig"]) | ((c["copy"] >= 90) & ((c["p"] >= 76) | (c["roi"] >= 76) | f["mid"]))))
    learn = (f["ultra"] & (c["ssim"] >= 70)) | (f["geom"] & (c["copy"] >= 72) & ((c["ssim"] >= 30) | (c["p"] >= 90))) | (rich & (c["copy"] >= 90) & (c["geometry"] >= 82) & (c["inliers"] >= 12)) | (f["hash"] & (c["copy"] >= 80))
    rows = rows.withColumn("base", base).withColumn("strong", strong)
    rows = rows.withColumn("suspect", suspect).withColumn("learn_safe", learn).withColumn("_raw", F.greatest(F.col("base"), c["geometry"], copy_lift, hash_lift, low_lift))
    capped = F.when(~F.col("strong"), F.least(F.col("_raw"), F.lit(policy.auto - policy.step))).otherwise(F.col("_raw"))
    capped = F.when(~F.col("suspect"), F.least(capped, F.lit(policy.similar - policy.step))).otherwise(capped)
    rows = rows.withColumn("score", F.least(F.lit(policy.top), F.greatest(none, capped)))
    return rows.drop(*[f"_{k}" for k in plain], *[f"_f_{k}" for k in flags], "_raw")


def best(fused: DataFrame, query: str, candidate: str) -> DataFrame:
    """Each query's candidate of the highest score; on ties the largest candidate key."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.desc(candidate))
    return fused.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def verdict(fused: DataFrame, policy: FusionPolicy = FusionPolicy()) -> DataFrame:
    """fused with verdict (similar or new), match_type and action (confirm, review or none); a new one scores 0."""
    similar = F.col("score") >= policy.similar
    kind = F.when((F.col("copy") >= 82) & (F.col("copy") >= F.greatest("geometry", "p")), "copy_model").when(F.col("geometry") >= 84, "local_match").when(F.col("p") >= 92, "high_similarity").otherwise("visual_similarity")
    return (
        fused.withColumn("verdict", F.when(similar, "similar").otherwise("new"))
        .withColumn("match_type", F.when(similar, kind))
        .withColumn("action", F.when(F.col("score") >= policy.auto, "confirm").when(similar, "review").otherwise("none"))
        .withColumn("score", F.when(similar, F.round("score", 2)).otherwise(0.0))
    )


def vetoed(fused: DataFrame, evidence: str, below: float = 56.0) -> DataFrame:
    """Negative evidence: a candidate whose evidence column is known and below the limit is new, whatever its score."""
    bad = F.coalesce(F.col(evidence) < below, F.lit(False))
    return fused.withColumn("score", F.when(bad, 0.0).otherwise(F.col("score"))).withColumn("strong", F.col("strong") & ~bad)
