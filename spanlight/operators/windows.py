"""Windows over the captions of a video, and over message and event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T
from ..options import DetectorOptions
from ..sources.tables import once_each, settled


def evidence_windows(scored: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """(video_id, start_idx, end_idx, score): of every run of captions whose trailing window holds enough evidence, the best window.

    scored: (video_id, event_idx, start_ms, end_ms, commercial, groups). The left edge of a
    window never moves back: it is the running maximum of the first caption that starts late
    enough. A group is inside if its last caption so far stands at or after the left edge.
    """
    last = W.partitionBy("video_id").orderBy("event_idx").rowsBetween(W.unboundedPreceding, 0)
    # Captions that start before a window's edge are counted in one pass over starts and edges.
    starts = scored.select("video_id", F.col("start_ms").alias("t"), F.lit(1).alias("is_start"), F.lit(None).cast("int").alias("event_idx"))
    edges = scored.select("video_id", (F.col("end_ms") - options.evidence_window).alias("t"), F.lit(0).alias("is_start"), F.col("event_idx").cast("int"))
    counted = starts.unionByName(edges).withColumn("before", F.sum("is_start").over(W.partitionBy("video_id").orderBy("t", "is_start").rowsBetween(W.unboundedPreceding, 0)))
    left = counted.filter("event_idx is not null").select("video_id", "event_idx", "before")
    rows = scored.join(left.hint("merge"), ["video_id", "event_idx"]).withColumn("left", F.max(F.least("event_idx", "before")).over(last))
    active = {g: F.coalesce(F.max(F.when((F.col("commercial") > 0) & F.array_contains("groups", g), F.col("event_idx"))).over(last) >= F.col("left"), F.lit(False)) for g in P.WEIGHTS}
    rows = rows.withColumns({f"has_{g}": c for g, c in active.items()})
    has = lambda g: F.col(f"has_{g}").cast("int")
    score, n, precise = sum(has(g) * w for g, w in P.WEIGHTS.items()), sum(map(has, P.WEIGHTS)), sum(map(has, P.PRECISE))
    rows = rows.select("video_id", "event_idx", F.col("left").cast("int").alias("start_idx"), score.alias("score"), ((score >= options.entry_score) & (n >= 2) & (precise >= 1)).alias("ok"))
    rows = rows.filter("ok").withColumn("run", F.col("event_idx") - F.row_number().over(W.partitionBy("video_id").orderBy("event_idx")))
    best = rows.groupBy("video_id", "run").agg(F.max(F.struct("score", "start_idx", (-F.col("event_idx")).alias("minus_end"))).alias("b"))
    return best.select("video_id", F.col("b.start_idx").alias("start_idx"), (-F.col("b.minus_end")).cast("int").alias("end_idx"), F.col("b.score").cast("int").alias("score"))


def brand_words(texts: DataFrame) -> DataFrame:
    """Adds what texts (text, normalized) hold of brands: named, capitals and said, all tokens, each once."""
    n = F.col("normalized")
    named = F.array_union(T.domain_roots(n), T.named_brands(n))
    capitals = T.capitalized_brands(F.col("text"), F.lit(True), F.array().cast("array<string>"))
    return texts.withColumns({"named": named, "capitals": capitals, "said": F.array_distinct(T.tokens(n))})


def brand_seeds(worded: DataFrame) -> DataFrame:
    """(video_id, event_idx, start_ms, brand, strength): domain roots and named brands weigh 3, capitalised words near a cue 2.

    Promo codes of the whole video are no brands. worded: captions with codes, groups and brand_words.
    """
    codes = worded.select("video_id", F.explode("codes").alias("brand")).distinct()
    cue = F.arrays_overlap("groups", F.array(*map(F.lit, (*P.PRECISE, "sponsor"))))
    seed = ["video_id", "event_idx", "start_ms"]
    strong = worded.select(*seed, F.explode("named").alias("brand"), F.lit(3).alias("strength"))
    weak = worded.filter(cue).select(*seed, F.explode(F.array_except("capitals", "codes")).alias("brand"), F.lit(2).alias("strength"))
    weak = weak.join(codes.hint("merge"), ["video_id", "brand"], "left_anti").select(strong.columns)
    return strong.unionByName(weak).groupBy(*seed, "brand").agg(F.max("strength").alias("strength"))


def repeated_brands(scored: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """(video_id, event_idx, brands, boost): captions that name a brand that is repeated nearby and close to where it was found.

    Only tokens that are a seed of their video are kept, so most captions leave early; the key
    is always video and token.
    """
    scored = once_each(scored.select("video_id", "event_idx", "start_ms", "end_ms", "text", "normalized", "codes", "groups"), ["text", "normalized"], brand_words, "words")
    seeds = settled(brand_seeds(scored), "seeds")
    by_brand = seeds.groupBy("video_id", "brand").agg(F.max("strength").alias("strength"))
    said = scored.select("video_id", "event_idx", "start_ms", "end_ms", F.explode("said").alias("brand"))
    mentions = said.join(by_brand.hint("merge"), ["video_id", "brand"])
    order = W.partitionBy("video_id", "brand").orderBy("event_idx")
    close = (F.col("start_ms") - F.lag("end_ms").over(order)) <= options.brand_window
    mentions = mentions.withColumn("again", F.max(F.coalesce(close, F.lit(False)).cast("int")).over(W.partitionBy("video_id", "brand"))).filter("again = 1")
    # The nearest seeds before and after a mention, in one pass each over both in order of time.
    places = seeds.select("video_id", "brand", "start_ms", F.col("start_ms").alias("seed_ms")).distinct()
    line = mentions.drop("end_ms", "again").unionByName(places, allowMissingColumns=True)
    at, by_time = F.col("start_ms"), W.partitionBy("video_id", "brand")
    before = F.last("seed_ms", ignorenulls=True).over(by_time.orderBy(at).rangeBetween(W.unboundedPreceding, 0))
    after = F.last("seed_ms", ignorenulls=True).over(by_time.orderBy(at.desc()).rangeBetween(W.unboundedPreceding, 0))
    close = F.least(at - before, after - at) <= options.brand_window
    near = line.withColumn("__near", close).filter("event_idx is not null and __near")
    near = near.select("video_id", "event_idx", "brand", "strength").distinct()
    return near.groupBy("video_id", "event_idx").agg(F.array_sort(F.collect_set("brand")).alias("brands"), F.sum(F.when(F.col("strength") >= 3, 4).otherwise(P.WEIGHTS["brand"])).cast("int").alias("boost"))


def pick_end_spans(candidates: DataFrame, ends: DataFrame, least_ms: float = 8_000) -> DataFrame:
    """(video_id, candidate_idx, end_idx, start_idx): per candidate and last caption the end span that starts latest.

    candidates: (video_id, candidate_idx, candidate_ms); ends: (video_id, start_idx, end_idx,
    end_ms). A span counts from the candidate's start on, and if it ends at least least_ms after
    it. Of spans with one last caption and one end only the one that starts latest can be picked, and a span
    that another of the same last caption beats in both start and end never is; so few spans a
    last caption are left to meet the candidates.
    """
    latest = ends.groupBy("video_id", "end_idx", "end_ms").agg(F.max("start_idx").alias("start_idx"))
    order = W.partitionBy("video_id", "end_idx").orderBy(F.col("end_ms").desc()).rowsBetween(W.unboundedPreceding, -1)
    best = latest.withColumn("__beaten", F.max("start_idx").over(order)).filter("__beaten is null or start_idx > __beaten").drop("__beaten")
    met = candidates.join(best, "video_id").filter((F.col("start_idx") >= F.col("candidate_idx")) & (F.col("end_ms") - F.col("candidate_ms") >= least_ms))
    return met.groupBy("video_id", "candidate_idx", "end_idx").agg(F.max("start_idx").alias("start_idx"))


def choose_track(tracks: DataFrame) -> DataFrame:
    """The best caption track of every video: English by hand, English, some English, any by hand, the first."""
    english, manual = F.col("language_code") == "en", F.coalesce(F.col("kind"), F.lit("")) != "asr"
    rank = F.when(english & manual, 0).when(english, 1).when(F.col("language_code").startswith("en"), 2).when(manual, 3).otherwise(4)
    order = W.partitionBy("video_id").orderBy("rank", "pos")
    return tracks.withColumn("rank", rank).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("rank", "n")


def messages_for_current_video(messages: DataFrame) -> DataFrame:
    """Transcript and status messages whose video is the tab's latest, with its generation: how often the tab has changed or lost its video.

    A blocked channel (CHANNEL_BLOCKED) leaves the tab without a video until the next change.
    """
    so_far = W.partitionBy("tab_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    turns = F.col("action").isin("VIDEO_CHANGED", "CHANNEL_BLOCKED")
    video = F.when(F.col("action") == "VIDEO_CHANGED", F.col("video_id"))
    held = messages.withColumn("__now", F.last(F.when(turns, F.struct(video.alias("video_id"))), ignorenulls=True).over(so_far)).withColumn("generation", F.count(F.when(turns, 1)).over(so_far))
    return held.filter(~turns & (F.col("video_id") == F.col("__now.video_id"))).drop("__now")


def drop_repeats(messages: DataFrame) -> DataFrame:
    """Drops a message whose body is that of the one before it of the same tab, video, generation and action."""
    order = W.partitionBy("tab_id", "video_id", "generation", "action").orderBy("seq")
    return messages.withColumn("__last", F.lag("body").over(order)).filter("__last is null or body is null or body <> __last").drop("__last")


#: Seconds that one part of a user's messages spans.
PART_S = 86_400


def running_skip_stats(skips: DataFrame) -> DataFrame:
    """Adds skipped and time_s: totals after each message, never below zero.

    A sum that is held at zero is the running sum less its lowest value so far, if that is
    negative. Sum and lowest value of stretches of time can be put together, so a user's messages
    are gone through by days, and only a row per day by user. Durations that are not positive
    and finite do not count. skips: (user_id, ts, seq, action, duration_s); ts is a time or a
    number of seconds.
    """
    kind = skips.schema["ts"].dataType.typeName()
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) if kind.startswith("timestamp") else F.col("ts")
    sign = F.when(F.col("action") == "RECORD", 1).otherwise(-1)
    valid = skips.filter("duration_s > 0 and duration_s < double('infinity') and not isnan(duration_s)").withColumn("__day", F.floor(seconds / PART_S))
    inside = W.partitionBy("user_id", "__day").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = valid.withColumn("__n", F.sum(sign).over(inside)).withColumn("__t", F.sum(sign * F.col("duration_s").cast("decimal(28,6)")).over(inside))
    rows = rows.withColumns({"__nlow": F.min("__n").over(inside), "__tlow": F.min("__t").over(inside)})
    days = valid.groupBy("user_id", "__day").agg(F.sum(sign).alias("n"), F.sum(sign * F.col("duration_s").cast("decimal(28,6)")).alias("t"))
    lows = rows.groupBy("user_id", "__day").agg(F.min("__n").alias("nlow"), F.min("__t").alias("tlow"))
    earlier = W.partitionBy("user_id").orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    days = days.join(lows, ["user_id", "__day"]).withColumns({"n0": zero(F.sum("n").over(earlier)), "t0": zero(F.sum("t").over(earlier))})
    days = days.withColumns({"n1": zero(F.min(F.col("n0") + F.col("nlow")).over(earlier)), "t1": zero(F.min(F.col("t0") + F.col("tlow")).over(earlier))})
    both = rows.join(days.select("user_id", "__day", "n0", "t0", "n1", "t1"), ["user_id", "__day"])
    held = lambda x: F.col(f"{x}0") + F.col(f"__{x}") - F.least(F.lit(0), F.col(f"{x}1"), F.col(f"{x}0") + F.col(f"__{x}low"))
    return both.withColumns({"skipped": held("n"), "time_s": held("t").cast("double")}).select(*skips.columns, "skipped", "time_s")


def skip_totals(skips: DataFrame) -> DataFrame:
    """(user_id, skipped, time_s): the last running totals of each user."""
    last = F.max_by(F.struct("skipped", "time_s"), F.struct("ts", "seq"))
    return running_skip_stats(skips).groupBy("user_id").agg(last.alias("t")).select("user_id", "t.skipped", "t.time_s")
