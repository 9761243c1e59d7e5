"""From caption events to sponsor segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T
from ..operators.events import caption_spans, clean_events
from ..operators.intervals import merge_local
from ..operators.reads import AGAINST, GROUPS, SEGMENT, bits, reads, stretches
from ..operators.signals import FLAGS, text_features, weight
from ..operators.windows import evidence_windows, repeated_brands
from ..options import DetectorOptions
from ..sources.tables import settled, spread


def keep_segments(segments: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    return segments.filter((segments.end_ms - segments.start_ms).between(options.min_segment, options.max_segment) & segments.category.isin(*options.categories))


def span_features(events: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """Captions with the features of the spans that end in them folded in, and the spans that open or close a read.

    Groups and flags unite; the commercial score is the best over the folds, spans in the order
    of their starts, each with the groups so far less the largest negative score so far. Spans
    without any signal change nothing and leave first; what stays is a table, as it is read twice.
    """
    if "normalized" not in events.columns:
        events = events.withColumn("normalized", T.normalize_text(F.col("text")))
    shown = F.size("groups") + F.size("negative_groups") + sum(F.col(k).cast("int") for k in FLAGS)
    found = text_features(caption_spans(spread(events, "video_id"), options)).withColumn("__shown", shown > 0)
    kept = ("start_idx", "groups", "negative_groups", "codes", "commercial", "negative", "score", *FLAGS)
    spans = settled(found.select("video_id", "end_idx", "__shown", *kept), "spans").filter("__shown")
    key = [F.col("video_id").alias("__v"), F.col("end_idx").alias("__at")]
    lists = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("all"))
    own, longer = F.get(F.filter("all", lambda s: s.start_idx == F.col("__at")), F.lit(0)), F.filter("all", lambda s: s.start_idx < F.col("__at"))
    no = F.array().cast("array<string>")
    zero = F.struct(F.coalesce(own.groups, no).alias("groups"), F.coalesce(own.negative, F.lit(0)).alias("negative"), F.coalesce(own.commercial, F.lit(0)).alias("commercial"))

    def fold(acc, s):
        groups, negative = F.array_union(acc.groups, s.groups), F.greatest(acc.negative, s.negative)
        return F.struct(groups.alias("groups"), negative.alias("negative"), F.greatest(acc.commercial, weight(groups) - negative).cast("int").alias("commercial"))

    flag = lambda k: F.exists("all", lambda s: s[k]).alias(k)
    folded = lists.select("__v", "__at", "all", own.codes.alias("codes"), F.aggregate(longer, zero, fold).alias("f")).select(
        "__v",
        "__at",
        F.coalesce("codes", no).alias("codes"),
        F.array_sort("f.groups").alias("groups"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda s: s.negative_groups)))).alias("negative_groups"),
        F.col("f.commercial").alias("commercial"),
        *map(flag, FLAGS),
        F.transform(F.filter("all", lambda s: s.ends), lambda s: F.struct(s.start_idx.alias("start"), s.ends_before.alias("before"))).alias("end_spans"),
    )
    opening = F.struct(F.col("end_idx").alias("end"), F.col("strong_start").alias("strong"), F.col("contextual_start").alias("contextual"), F.col("endorsement_start").alias("endorsement"), F.col("self_promotion_start").alias("self_start"), "score")
    opened = spans.filter("starts").groupBy("video_id", F.col("start_idx").alias("event_idx")).agg(F.sort_array(F.collect_list(opening)).alias("start_spans"))
    # Both sides grow with the captions: by the size of a few columns in files Spark would take one for small, and gather it in the driver.
    folded, opened = folded.hint("merge"), opened.hint("merge")
    out = events.join(folded, (events.video_id == folded["__v"]) & (events.event_idx == folded["__at"]), "left").drop("__v", "__at").join(opened, ["video_id", "event_idx"], "left")
    lists_ = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("codes", "groups", "negative_groups", "end_spans")}
    return out.withColumns(lists_ | {"commercial": F.coalesce("commercial", F.lit(0))} | {k: F.coalesce(k, F.lit(False)) for k in FLAGS})


def caption_words(scored: DataFrame, stretched: DataFrame) -> DataFrame:
    """(video_id, event_idx, words): topic tokens of the captions of stretches, with their counts and idf over the whole video."""
    keys = ["video_id", "event_idx"]
    seeded = stretched.select("video_id").distinct()
    tokens = scored.join(seeded.hint("merge"), "video_id", "left_semi").select(*keys, T.topic_tokens(F.col("normalized")).alias("tokens"))
    df = tokens.select("video_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("video_id", "token").agg(F.count("*").alias("df"))
    size = tokens.groupBy("video_id").agg(F.count("*").alias("captions"))
    idf = df.join(size.hint("merge"), "video_id").select("video_id", "token", (F.log((F.col("captions") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    own = stretched.select(*keys, F.explode(T.topic_tokens(F.col("normalized"))).alias("token"))
    own = own.groupBy("video_id", "event_idx", "token").agg(F.count("*").alias("n")).join(idf.hint("merge"), ["video_id", "token"])
    return own.groupBy(*keys).agg(F.collect_list(F.struct("token", "n", "idf")).alias("words"))


def detect_segments(captions: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """(video_id, start_ms, end_ms, confidence, category, reason, score, groups, brands) of captions (video_id, start_ms, end_ms, text).

    Every stage is keyed by video. Clean events and scores are read by several later steps, so
    they are tables: patterns are matched once. Only captions that some seed can reach are walked,
    in stretches that no seed crosses, so a long or popular video is many groups.
    """
    events = settled(clean_events(captions).withColumn("normalized", T.normalize_text(F.col("text"))), "events")
    scored = settled(span_features(events, options), "scored")
    boosts = repeated_brands(spread(scored, "video_id"), options)
    keys, none = ["video_id", "event_idx"], F.array().cast("array<string>")
    scored = scored.join(boosts.hint("merge"), keys, "left").withColumns(
        {
            "groups": F.when(F.col("boost") > 0, F.array_sort(F.array_union("groups", F.array(F.lit("brand"))))).otherwise(F.col("groups")),
            "commercial": F.col("commercial") + F.coalesce("boost", F.lit(0)),
            "brands": F.coalesce("brands", none),
        }
    )
    scored = settled(scored, "boosted")
    windows = evidence_windows(scored.select(*keys, "start_ms", "end_ms", "commercial", "groups"), options)
    windows = windows.groupBy("video_id", F.col("start_idx").alias("event_idx")).agg(F.collect_list(F.struct(F.col("end_idx").alias("end"), "score")).alias("windows"))
    order = W.partitionBy("video_id").orderBy("event_idx")
    n = F.col("normalized")
    rows = scored.join(windows.hint("merge"), keys, "left").select(
        *keys, "start_ms", "end_ms", "brands", "commercial", "starts", "self_promotion", "self_promotion_start", "affiliate", "start_spans", "end_spans", "windows", "normalized",
        bits(F.col("groups"), GROUPS).alias("mask"), bits(F.col("negative_groups"), AGAINST).alias("against"),
        F.lead("start_ms").over(order).alias("next_ms"), F.lead("commercial").over(order).alias("next_commercial"),
        (F.col("start_spans").isNotNull() | F.col("windows").isNotNull()).alias("seeded"),
    )
    rows = settled(stretches(rows, options), "stretches")
    empty = lambda c: F.coalesce(c, F.expr("array()").cast(rows.schema[c].dataType)).alias(c)
    held = rows.join(caption_words(scored, rows).hint("merge"), keys, "left").select(
        *keys, "stretch", "start_ms", "end_ms", F.coalesce("next_ms", "end_ms").alias("next_ms"), F.coalesce("next_commercial", F.lit(0)).alias("next_commercial"),
        "mask", "against", "brands", "commercial", "starts", "self_promotion", "self_promotion_start", "affiliate",
        T.matches(n, P.LEAD_IN).alias("lead_in"), T.matches(n, P.PRE_ROLL).alias("pre_roll"),
        empty("start_spans"), "end_spans", empty("windows"),
        F.coalesce("words", F.expr("array()").cast("array<struct<token:string,n:long,idf:double>>")).alias("words"),
    )
    kind = captions.schema["video_id"].dataType.simpleString()
    found = spread(held, "video_id", "stretch").groupBy("video_id", "stretch").applyInPandas(reads(options), f"video_id {kind}, {SEGMENT}")
    return merge_local(keep_segments(found, options), options)
