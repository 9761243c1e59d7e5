"""Scores and flags of caption texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T
from ..functions.structure import RULES, structure
from ..sources.tables import once_each

FLAGS = ("starts", "strong_start", "contextual_start", "endorsement_start", "self_promotion_start", "ends", "ends_before", "negated", "self_promotion", "affiliate")
SCORES = ("score", "commercial", "positive", "negative")
#: What features adds beside normalized.
FOUND = ("codes", "groups", "negative_groups", *FLAGS, *SCORES)


def named(groups: dict[str, Column]) -> Column:
    """The names whose condition holds, sorted."""
    return F.array_compact(F.array(*(F.when(groups[g], F.lit(g)) for g in sorted(groups))))


def weight(groups: Column, weights: dict[str, int] = P.WEIGHTS) -> Column:
    return sum((F.when(F.array_contains(groups, g), w).otherwise(0) for g, w in weights.items()), F.lit(0))


def features(df: DataFrame, text: str = "text", exact: bool = True) -> DataFrame:
    """Adds normalized, codes, groups, negative_groups, the flags and the scores of a text.

    exact=False leaves out the fuzzy and word-order rules, and so all Python. Texts without any
    word that a pattern needs, nearly all, meet one cheap pattern only.
    """
    n, c = F.col("normalized"), F.col("codes")
    if "normalized" not in df.columns:
        df = df.withColumn("normalized", T.normalize_text(F.col(text)))
    df = df.withColumn("codes", T.promo_codes(F.col(text), n))
    df = df.withColumn("__may", n.rlike(P.GATE))
    matches = lambda patterns: F.col("__may") & T.matches(n, patterns)
    rules = structure(n) if exact else F.struct(*(F.lit(False).alias(k) for k in RULES))
    df = df.withColumn("__rules", rules)
    rule = lambda k: F.col(f"__rules.{k}")
    hits = {g: matches(p) for g, p in P.SIGNALS.items()}
    hits["code"] = hits["code"] | (F.size(c) > 0)
    against = {g: matches(p) for g, p in P.NEGATIVES.items()}
    df = df.withColumn("negative_groups", named(against)).withColumn("negated", F.array_contains("negative_groups", "explicitNegation"))
    hits["sponsor"] = (hits["sponsor"] | rule("fuzzy_word")) & ~F.col("negated")
    df = df.withColumn("groups", named(hits)).withColumns(
        {
            "__strong": matches(P.STRONG_START),
            "__contextual": matches(P.CONTEXTUAL_START),
            "self_promotion_start": matches(P.SELF_PROMOTION_START),
            "endorsement_start": rule("structural_role") | matches(P.ENDORSEMENT_START),
            "ends_before": matches(P.END_BEFORE),
            "self_promotion": matches(P.SELF_PROMOTION),
            "affiliate": F.array_contains("groups", "affiliate"),
        }
    )
    open_ = ~F.col("__strong") & ~F.col("__contextual") & ~F.col("self_promotion_start") & rule("fuzzy_start")
    df = df.withColumns(
        {
            "strong_start": ~F.col("negated") & (F.col("__strong") | rule("structural_start") | open_),
            "contextual_start": ~F.col("negated") & (F.col("__contextual") | rule("structural_role")),
            "ends": F.col("ends_before") | matches(P.END) | rule("fuzzy_end"),
        }
    ).withColumn("starts", F.col("strong_start") | F.col("contextual_start") | F.col("self_promotion_start"))
    total, minus = weight(F.col("groups")), weight(F.col("negative_groups"), P.NEGATIVE_WEIGHTS)
    bonus = F.when(F.col("starts"), P.START_BONUS).otherwise(0) + F.when(F.col("ends"), P.END_BONUS).otherwise(0)
    df = df.withColumns({"positive": (total + bonus).cast("int"), "negative": minus.cast("int"), "commercial": F.greatest(F.lit(0), total - minus).cast("int")})
    return df.withColumn("score", F.greatest(F.lit(0), F.col("positive") - F.col("negative"))).drop("__rules", "__may", "__strong", "__contextual")


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """features, worked out once for each distinct text."""
    keys = [text, "normalized"] if "normalized" in df.columns else [text]
    return once_each(df, keys, lambda texts: features(texts, text).select(text, "normalized", *FOUND), "texts")


def classify(explicit: Column, self_promotion: Column, affiliate: Column, has_brand: Column, groups: Column) -> Column:
    sponsor = F.array_contains(groups, "sponsor")
    precise = F.arrays_overlap(groups, F.array(*map(F.lit, P.PRECISE)))
    return (
        F.when(self_promotion & ~affiliate & ~sponsor, "self-promotion")
        .when(explicit, "paid-sponsor")
        .when(affiliate & ~sponsor, "affiliate")
        .when(sponsor | (has_brand & precise), "paid-sponsor")
        .otherwise("commercial-unknown")
    )
