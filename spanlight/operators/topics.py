"""Topic vectors of stretches of a video, and their likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import DetectorOptions
from ..sources.tables import once_each, settled
from .intervals import meeting


def caption_tokens(events: DataFrame) -> DataFrame:
    """(video_id, event_idx, start_ms, end_ms, token, n): topic tokens of captions with their counts."""
    keys = ["video_id", "event_idx", "start_ms", "end_ms"]
    listed = once_each(events.select(*keys, "text"), ["text"], lambda t: t.withColumn("tokens", T.topic_tokens(T.normalize_text(F.col("text")))), "topics")
    words = listed.select(*keys, F.explode("tokens").alias("token"))
    return words.groupBy("video_id", "event_idx", "start_ms", "end_ms", "token").agg(F.count("*").alias("n"))


def document_frequency(events: DataFrame) -> DataFrame:
    """(video_id, token, df, idf): in how many captions of the video a token occurs; idf = ln((captions + 1) / (df + 1)) + 1."""
    return _frequency(caption_tokens(events), events)


def _frequency(tokens: DataFrame, events: DataFrame) -> DataFrame:
    df = tokens.groupBy("video_id", "token").agg(F.count("*").alias("df"))
    size = events.groupBy("video_id").agg(F.count("*").alias("captions"))
    return df.join(size, "video_id").select("video_id", "token", "df", (F.log((F.col("captions") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def topic_vectors(windows: DataFrame, events: DataFrame) -> DataFrame:
    """(video_id, window_id, token, weight) of windows (video_id, window_id, from_ms, to_ms): (1 + ln count) * idf, edges included.

    The tokens of captions, which several steps read, are a table. Their frequencies grow with the captions
    as they do, so neither is gathered in the driver.
    """
    tokens = settled(caption_tokens(events), "tokens")
    words = tokens.select("video_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), "token", "n")
    stretches = windows.select("video_id", "window_id", F.col("from_ms").alias("start_ms"), F.col("to_ms").alias("end_ms"))
    counts = meeting(stretches, words).groupBy("video_id", "window_id", "token").agg(F.sum("n").alias("n"))
    return counts.join(_frequency(tokens, events).hint("merge"), ["video_id", "token"]).select("video_id", "window_id", "token", ((1 + F.log("n")) * F.col("idf")).alias("weight"))


def topic_similarity(left: DataFrame, right: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """Per (video_id, window_id) in both: cosine, weighted Jaccard, shared tokens, and whether the topic has returned."""
    keys = ["video_id", "window_id"]
    pairs = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys)
    a = left.join(pairs, keys).select(*keys, "token", F.col("weight").alias("a"), F.lit(0.0).alias("b"))
    b = right.join(pairs, keys).select(*keys, "token", F.lit(0.0).alias("a"), F.col("weight").alias("b"))
    both = a.unionByName(b).groupBy(*keys, "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = both.groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("b")).alias("dot"),
        F.sum(F.col("a") * F.col("a")).alias("aa"),
        F.sum(F.col("b") * F.col("b")).alias("bb"),
        F.sum(F.least("a", "b")).alias("least"),
        F.sum(F.greatest("a", "b")).alias("most"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"),
    )
    out = sums.select(*keys, (F.col("dot") / F.sqrt(F.col("aa") * F.col("bb"))).alias("cosine"), (F.col("least") / F.col("most")).alias("jaccard"), "shared")
    return out.withColumn("returned", (F.col("shared") >= 2) & (F.col("cosine") >= options.topic_cosine) & (F.col("jaccard") >= options.topic_jaccard))
