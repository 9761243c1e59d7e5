"""Segments as intervals: merging, matching, trimming, covering. Times are milliseconds, keys come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import DetectorOptions

COMMUNITY_GAP, DEFAULT_TRIM_S, MOST_TRIM_S = 10_000, 3.0, 60.0


#: The cells of the lowest level are 2^LOWEST milliseconds wide; each further level's are 2^STEP times as wide.
LOWEST, STEP, HIGHEST = 16, 2, 1022


def _level(start: Column, end: Column) -> Column:
    """The lowest level whose cells are at least as wide as the interval, which so lies in two of them at most."""
    bits = F.ceil(F.log2(F.greatest(end - start, F.lit(1.0))))
    return F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), F.ceil((bits - LOWEST) / STEP) * STEP + LOWEST)).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level))


def levels(df: DataFrame, start: str, end: str) -> Column:
    """The levels that the table's intervals have, a handful, as an array for any other table's rows."""
    return df.filter(_proper(start, end)).agg(F.collect_set(_level(F.col(start), F.col(end))).alias("levels")).scalar()


def _proper(start: str, end: str) -> str:
    """Both times are finite and in order."""
    return f"{end} >= {start} and abs({start}) < double('infinity') and abs({end}) < double('infinity')"


def celled(df: DataFrame, start: str, end: str, others: Column, own: str) -> DataFrame:
    """A row per cell that an interval covers on its own level and on those higher levels that occur in `others`: adds own (its level), __level and __cell."""
    rows = df.withColumn(own, _level(F.col(start), F.col(end))).withColumn("__others", others)
    mine = F.array_distinct(F.concat(F.array(own), F.filter("__others", lambda x: x > F.col(own))))
    rows = rows.withColumn("__level", F.explode(mine)).drop("__others")
    return rows.withColumn("__cell", F.explode(F.sequence(_cell(F.col(start), F.col("__level")), _cell(F.col(end), F.col("__level")))))


def meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of left (video_id, start_ms, end_ms, ...) and right (video_id, r_start, r_end, ...) rows of one video whose times touch.

    Time is cut into cells of powers of two. An interval stands in the one or two cells of the level of its
    length, and in those above them on the levels that the other table's longer intervals have; a pair
    meets on the level of the longer one, in the first cell that both share. So an interval of any length is
    a few rows, and long ones meet short ones without being cut up. Both ends count; intervals
    that end before they start, or have no finite times, meet none.
    """
    a, b = left.filter(_proper("start_ms", "end_ms")), right.filter(_proper("r_start", "r_end"))
    a = celled(a, "start_ms", "end_ms", levels(right, "r_start", "r_end"), "__left")
    b = celled(b, "r_start", "r_end", levels(left, "start_ms", "end_ms"), "__right")
    both = a.join(b, ["video_id", "__level", "__cell"]).filter("r_start <= end_ms and r_end >= start_ms")
    first = _cell(F.greatest("start_ms", "r_start"), F.col("__level"))
    return both.filter((F.col("__level") == F.greatest("__left", "__right")) & (F.col("__cell") == first)).drop("__level", "__cell", "__left", "__right")


def islands(df: DataFrame, gap: float, order: list[str], keys: list[str] = ["video_id"]) -> DataFrame:
    """Adds island: a number per run of rows whose start is at most gap after all earlier ends."""
    by = W.partitionBy(*keys).orderBy(*order)
    reached = F.max("end_ms").over(by.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start_ms") > reached + gap), 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn("island", F.sum("__opens").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("__opens")


def coverage(segments: DataFrame, keys: list[str] = ["video_id"]) -> DataFrame:
    """(keys, covered_ms): length of the union of the intervals."""
    runs = islands(segments, 0, ["start_ms", "end_ms"], keys).groupBy(*keys, "island").agg((F.max("end_ms") - F.min("start_ms")).alias("ms"))
    return runs.groupBy(*keys).agg(F.sum("ms").alias("covered_ms"))


def normalize_segments(segments: DataFrame, source: str) -> DataFrame:
    """Valid segments, merged where one starts within a second of the reach of those before.

    The first row of a run gives source, confidence and reason; auto_skip holds if it holds for
    all; the first model that is named stands. Columns that are absent get their defaults.
    """
    has = set(segments.columns)
    default = "community" if source == "sponsorblock" else "unknown"
    col = lambda c, kind, other: F.coalesce(F.col(c), F.lit(other)) if c in has else F.lit(other).cast(kind)
    clean = segments.select(
        "video_id",
        "start_ms",
        "end_ms",
        col("source", "string", source).alias("source"),
        col("confidence", "string", default).alias("confidence"),
        col("reason", "string", "").alias("reason"),
        col("auto_skip", "boolean", True).alias("auto_skip"),
        (F.nullif(F.trim("model"), F.lit("")) if "model" in has else F.lit(None).cast("string")).alias("model"),
    ).filter("start_ms >= 0 and end_ms > start_ms and end_ms < double('infinity') and not isnan(end_ms)")
    first = F.struct("start_ms", "end_ms", "source", "confidence", "reason")
    runs = islands(clean, 1000, ["start_ms", "end_ms", "source", "confidence", "reason"]).groupBy("video_id", "island")
    out = runs.agg(
        F.min(first).alias("f"),
        F.max("end_ms").alias("end_ms"),
        F.bool_and("auto_skip").alias("auto_skip"),
        F.min(F.when(F.col("model").isNotNull(), F.struct("start_ms", "end_ms", "model"))).alias("m"),
    )
    return out.select("video_id", F.col("f.start_ms").alias("start_ms"), "end_ms", "f.source", "f.confidence", "f.reason", "auto_skip", F.col("m.model").alias("model"))


def merge_answers(segments: DataFrame, keys: list[str] = ["video_id"]) -> DataFrame:
    """Merges within a second: the strongest confidence, paid-sponsor where categories differ, reasons joined in order."""
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    rows = islands(segments.withColumn("rank", rank), 1000, ["start_ms", "end_ms", "category", "reason"], keys)
    item = F.struct("start_ms", "end_ms", "category", "reason", "rank", "confidence")
    runs = rows.groupBy(*keys, "island").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.max(F.struct("rank", "confidence")).confidence.alias("confidence"),
        F.when(F.min("category") == F.max("category"), F.min("category")).otherwise("paid-sponsor").alias("category"),
        F.sort_array(F.collect_list(item)).alias("items"),
    )
    reasons = F.transform("items", lambda x: x.reason)
    # The set is of whole strings: what is joined so far is compared with the next reason.
    joined = F.aggregate(F.slice(reasons, 2, F.greatest(F.size(reasons), F.lit(1))), F.element_at(reasons, 1), lambda acc, r: F.when(acc == r, acc).otherwise(F.substring(F.concat(acc, F.lit("; "), r), 1, 160)))
    return runs.select(*keys, "start_ms", "end_ms", "confidence", "category", joined.alias("reason"))


def merge_ranges(candidates: DataFrame, context: Column, keys: list[str] = ["video_id"]) -> DataFrame:
    """Candidates widened by a context on both sides, merged where they overlap or touch."""
    wide = candidates.select(*keys, (F.col("start_ms") - context).alias("start_ms"), (F.col("end_ms") + context).alias("end_ms")).filter("end_ms > start_ms")
    return islands(wide, 0, ["start_ms", "end_ms"], keys).groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def category_of_two(a: Column, b: Column) -> Column:
    unknown = F.lit("commercial-unknown")
    return F.when(a == b, a).when((a == "paid-sponsor") | (b == "paid-sponsor"), "paid-sponsor").when(a == unknown, b).when(b == unknown, a).otherwise("mixed-commercial")


SEGMENT = "struct<start_ms:double,end_ms:double,confidence:string,category:string,reason:string,score:int,groups:array<string>,brands:array<string>>"


def merge_local(segments: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """Merges neighbours within merge_gap as long as the whole stays within max_segment.

    The cap makes it sequential, so it is an ordered fold, over the segments between two gaps
    that are too wide to merge anyhow.
    """
    fields = ("start_ms", "end_ms", "confidence", "category", "reason", "score", "groups", "brands")
    runs = islands(segments, options.merge_gap, ["start_ms", "end_ms"])
    lists = runs.groupBy("video_id", "island").agg(F.sort_array(F.collect_list(F.struct(*fields))).cast(f"array<{SEGMENT}>").alias("items"))
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)

    def union(a: Column, b: Column) -> Column:
        return F.array_sort(F.array_union(a, b))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        reach = F.greatest(last.end_ms, x.end_ms)
        joins = (F.size(done) > 0) & (x.start_ms - last.end_ms <= options.merge_gap) & (reach - F.least(last.start_ms, x.start_ms) <= options.max_segment)
        parts = F.array_distinct(F.split(F.concat(last.reason, F.lit("+"), x.reason, F.lit("+merged")), "\\+"))
        both = F.struct(
            last.start_ms.alias("start_ms"),
            reach.alias("end_ms"),
            F.when(rank(last.confidence) >= rank(x.confidence), last.confidence).otherwise(x.confidence).alias("confidence"),
            category_of_two(last.category, x.category).alias("category"),
            F.array_join(parts, "+").alias("reason"),
            F.greatest(last.score, x.score).alias("score"),
            union(last.groups, x.groups).alias("groups"),
            union(last.brands, x.brands).alias("brands"),
        ).cast(SEGMENT)
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate("items", F.array().cast(f"array<{SEGMENT}>"), step)
    return lists.select("video_id", F.inline(merged))


def trim_segments(segments: DataFrame, start_s: Column | None = None, end_s: Column | None = None) -> DataFrame:
    """Cuts trims off both edges; of community segments only at the edges of clusters. Emptied ones go."""
    trim = lambda s: F.when(s.isNull() | F.isnan(s), DEFAULT_TRIM_S).otherwise(F.least(F.lit(MOST_TRIM_S), F.greatest(F.lit(0.0), s))) * 1000
    head, tail = (trim(F.lit(DEFAULT_TRIM_S) if s is None else s.cast("double")) for s in (start_s, end_s))
    by = W.partitionBy("video_id", "source").orderBy("start_ms", "end_ms")
    before, after = F.lag("end_ms").over(by), F.lead("start_ms").over(by)
    own = F.col("source") != "sponsorblock"
    opens = own | before.isNull() | (F.col("start_ms") - before > COMMUNITY_GAP)
    closes = own | after.isNull() | (after - F.col("end_ms") > COMMUNITY_GAP)
    out = segments.withColumns({"__start": F.col("start_ms") + F.when(opens, head).otherwise(0.0), "__end": F.col("end_ms") - F.when(closes, tail).otherwise(0.0)})
    return out.withColumns({"start_ms": F.col("__start"), "end_ms": F.col("__end")}).drop("__start", "__end").filter("end_ms > start_ms")


def matches_candidate(c_start: Column, c_end: Column, a_start: Column, a_end: Column) -> Column:
    """Whether an answered range confirms a candidate: it covers its middle, or much of it."""
    shared = F.least(c_end, a_end) - F.greatest(c_start, a_start)
    middle = c_start + (c_end - c_start) / 2
    return (c_end > c_start) & (a_end > a_start) & (shared > 0) & (((a_start <= middle) & (a_end >= middle)) | (shared >= F.least(F.lit(5000.0), (c_end - c_start) / 2)))


def match_candidates(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers that confirm a candidate of their video: (video_id, start_ms, end_ms, a_start, a_end)."""
    met = meeting(candidates.select("video_id", "start_ms", "end_ms"), answers.select("video_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")))
    confirmed = met.filter(matches_candidate(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")))
    return confirmed.withColumnsRenamed({"r_start": "a_start", "r_end": "a_end"})


def suppress_undone(segments: DataFrame, undone: DataFrame, cancelled: DataFrame, least_s: float = 0.25) -> DataFrame:
    """Segments (video_id, start_s, end_s, key) that no undone range overlaps by more than least_s and whose key is not cancelled."""
    ms = lambda df, start, end: df.select("video_id", "start_s", "end_s", (F.col("start_s") * 1000).alias(start), (F.col("end_s") * 1000).alias(end))
    met = meeting(ms(segments, "start_ms", "end_ms").distinct(), ms(undone, "r_start", "r_end").withColumnsRenamed({"start_s": "u_start", "end_s": "u_end"}))
    gone = met.filter(F.least("end_s", "u_end") - F.greatest("start_s", "u_start") > least_s).select("video_id", "start_s", "end_s").distinct()
    return segments.join(gone, ["video_id", "start_s", "end_s"], "left_anti").join(cancelled.select("video_id", "key"), ["video_id", "key"], "left_anti")


def label_positions(positions: DataFrame, segments: DataFrame, soon_s: float = 15.0) -> DataFrame:
    """(video_id, event_id, pos_s, skip_to, next_start): the end of the first segment around a position, else the nearest start ahead.

    A position stands in the cells of the levels that segments have, so it meets those near it
    and long ones around it, a row each; one that meets none is kept.
    """
    s = segments.select(F.col("video_id").alias("__v"), "start_s", "end_s", ((F.col("start_s") - soon_s) * 1000).alias("__from"), (F.col("end_s") * 1000).alias("__to"))
    s = s.filter(_proper("__from", "__to"))
    cells = celled(s, "__from", "__to", F.array().cast("array<int>"), "__own").select("__v", F.col("__level").alias("__l"), F.col("__cell").alias("__c"), "start_s", "end_s")
    p = positions.withColumn("__levels", levels(s, "__from", "__to")).withColumn("__level", F.explode_outer("__levels"))
    p = p.withColumn("__cell", _cell(F.col("pos_s") * 1000, F.col("__level")))
    near = p.join(cells, (p.video_id == cells["__v"]) & (p["__level"] == cells["__l"]) & (p["__cell"] == cells["__c"]) & (p.pos_s >= cells.start_s - soon_s) & (p.pos_s < cells.end_s), "left")
    inside = (F.col("pos_s") >= F.col("start_s")) & (F.col("pos_s") < F.col("end_s"))
    found = near.groupBy("video_id", "event_id", "pos_s").agg(F.min(F.when(inside, F.struct("start_s", "end_s"))).alias("i"), F.min(F.when(~inside & (F.col("start_s") > F.col("pos_s")), F.col("start_s"))).alias("ahead"))
    return found.select("video_id", "event_id", "pos_s", F.col("i.end_s").alias("skip_to"), F.when(F.col("i").isNull(), F.col("ahead")).alias("next_start"))


def overlap_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(video_id, start_ms, end_ms): every intersection of positive length."""
    met = meeting(predicted.select("video_id", "start_ms", "end_ms"), truth.select("video_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")))
    start, end = F.greatest("start_ms", "r_start"), F.least("end_ms", "r_end")
    return met.filter(end > start).select("video_id", start.alias("start_ms"), end.alias("end_ms"))


def best_match(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth rows (with truth_id) and the best prediction: iou over the hull, and the start and end errors; the first wins a tie.

    Only predictions that meet a truth row are compared with it; rows that none meets have nulls.
    """
    keys = ["video_id", "truth_id", "start_ms", "end_ms"]
    met = meeting(truth.select(keys), predicted.select("video_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")))
    shared = F.greatest(F.lit(0.0), F.least("end_ms", "r_end") - F.greatest("start_ms", "r_start"))
    hull = F.greatest("end_ms", "r_end") - F.least("start_ms", "r_start")
    pairs = met.withColumn("iou", F.when(hull > 0, shared / hull).otherwise(0.0)).filter("iou > 0")
    best = pairs.groupBy(keys).agg(F.min(F.struct((-F.col("iou")).alias("minus"), "r_start", "r_end")).alias("b"))
    rows = truth.select(keys).join(best, keys, "left")
    return rows.select("video_id", "truth_id", (-F.col("b.minus")).alias("iou"), F.abs(F.col("b.r_start") - F.col("start_ms")).alias("start_error"), F.abs(F.col("b.r_end") - F.col("end_ms")).alias("end_error"))


def timeline_markers(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, left_percent, width_percent) of segments in seconds on videos of duration_s; empty ones go."""
    start = F.least(F.col("duration_s"), F.greatest(F.lit(0.0), F.col("start_s")))
    end = F.least(F.col("duration_s"), F.greatest(start, F.col("end_s")))
    return segments.join(videos, "video_id").filter(end > start).select("video_id", (start / F.col("duration_s") * 100).alias("left_percent"), ((end - start) / F.col("duration_s") * 100).alias("width_percent"))
