"""Which segments of a video are delivered: blocked channels, sources, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_handle
from ..sources.tables import settled
from .intervals import match_candidates, matches_candidate, meeting, normalize_segments, trim_segments

SHORT_MS, SHORT_CONTEXT_MS, LEAST_CONTEXT_MS, MOST_CONTEXT_MS = 25_000, 60_000, 90_000, 240_000


def drop_blocked(videos: DataFrame, blocked: DataFrame) -> DataFrame:
    """Videos (with handle) whose channel is not on the list; handles are compared in normal form, blank ones never block."""
    names = blocked.select(normalize_handle(F.col("handle")).alias("__b")).filter("__b <> ''").distinct()
    return videos.join(names, normalize_handle(F.col("handle")) == F.col("__b"), "left_anti")


def with_hits(videos: DataFrame, community: DataFrame) -> DataFrame:
    """Adds hit: whether community segments serve the video; mode local-only does not ask for them."""
    known = community.select("video_id").distinct().withColumn("__c", F.lit(True))
    return videos.join(known, "video_id", "left").withColumn("hit", F.coalesce("__c", F.lit(False)) & (F.col("mode") != "local-only")).drop("__c")


def route_sources(videos: DataFrame, community: DataFrame, local: DataFrame, llm: DataFrame) -> DataFrame:
    """(video_id, route): the source that serves a video of (video_id, mode).

    Modes are local-only, which asks no community, sponsorblock-only, which asks no local
    detector, and local-fallback, which asks both. A community hit wins, then the local
    detector, then the language model, which all modes may ask; without any the route is none.
    """
    has = lambda df, name: df.select("video_id").distinct().withColumn(name, F.lit(True))
    rows = with_hits(videos, community).join(has(local, "l"), "video_id", "left").join(has(llm, "m"), "video_id", "left")
    route = F.when(F.col("hit"), "community").when(F.col("l") & (F.col("mode") != "sponsorblock-only"), F.col("mode")).when(F.col("m"), "llm-fallback").otherwise("none")
    return rows.select("video_id", route.alias("route"))


def deliverable(local: DataFrame, llm_enabled: bool = True) -> DataFrame:
    """Local segments that need no verification: all without a model; none of a video with an unsure one; else all but short ones."""
    if not llm_enabled:
        return local
    unsure = local.groupBy("video_id").agg(F.bool_or(F.col("confidence").isin("medium", "low")).alias("unsure")).filter("not unsure").select("video_id")
    short = (F.col("confidence") == "high") & (F.col("end_ms") - F.col("start_ms") <= SHORT_MS)
    return local.join(unsure, "video_id", "left_semi").filter(~short)


def llm_plan(videos: DataFrame, local: DataFrame, community: DataFrame) -> DataFrame:
    """(video_id, kind, start_ms, end_ms, context_ms, confidence): verification jobs of the videos (video_id, mode) that need the model.

    A community hit needs none, nor does a video whose local segments are all sure and long.
    Unsure segments are verified in a context of twice their length within bounds; else short
    sure ones in a fixed context; a video without local segments, or whose mode does not ask
    for any, is scanned as a whole (no range).
    """
    length = F.col("end_ms") - F.col("start_ms")
    unsure, short = F.col("confidence").isin("medium", "low"), (F.col("confidence") == "high") & (length <= SHORT_MS)
    open_ = settled(with_hits(videos, community).filter("not hit").select("video_id", "mode"), "open")
    ranked = local.join(open_.filter("mode <> 'sponsorblock-only'").select("video_id"), "video_id", "left_semi").withColumn("rank", F.when(unsure, 2).when(short, 1).otherwise(0))
    ranked = settled(ranked.select("video_id", "start_ms", "end_ms", "confidence", "rank"), "ranked")
    top = open_.select("video_id").distinct().join(ranked.groupBy("video_id").agg(F.max("rank").alias("top")), "video_id", "left")
    jobs = ranked.join(top.filter("top > 0"), "video_id").filter("rank = top")
    context = F.when(F.col("rank") == 2, F.least(F.lit(float(MOST_CONTEXT_MS)), F.greatest(F.lit(float(LEAST_CONTEXT_MS)), length * 2))).otherwise(float(SHORT_CONTEXT_MS))
    kind = F.when(F.col("rank") == 2, "candidate-verification").otherwise("short-verification")
    named = jobs.select("video_id", kind.alias("kind"), "start_ms", "end_ms", context.alias("context_ms"), "confidence")
    no = F.lit(None).cast("double")
    return named.unionByName(top.filter("top is null").select("video_id", F.lit("fallback").alias("kind"), no.alias("start_ms"), no.alias("end_ms"), no.alias("context_ms"), F.lit(None).cast("string").alias("confidence")))


def numbered_jobs(plan: DataFrame) -> DataFrame:
    """Adds job_id to a plan: a number per job of a video, in the order of times."""
    return plan.withColumn("job_id", F.row_number().over(W.partitionBy("video_id").orderBy("start_ms", "end_ms", "confidence")) - 1)


def combine_verified(local: DataFrame, answers: DataFrame, plan: DataFrame) -> DataFrame:
    """(video_id, start_ms, end_ms, origin): local segments that verification leaves, and the answers."""
    kind, span = plan.select("video_id", "kind").distinct(), ["video_id", "start_ms", "end_ms"]
    rows = local.join(kind, "video_id").filter("kind <> 'fallback'")
    planned = plan.filter("start_ms is not null").select(span)
    confirmed = match_candidates(rows.filter("kind = 'candidate-verification'").select(span).distinct(), answers).select(span)
    kept = rows.join(planned.unionByName(confirmed).distinct(), span, "left_anti")
    cut = lambda df, name: df.select(*span, F.lit(name).alias("origin"))
    return cut(kept, "local").unionByName(cut(answers.join(kind, "video_id", "left_semi"), "llm"))


def accepted_answers(answers: DataFrame, plan: DataFrame) -> DataFrame:
    """The answers of planned videos: all of a whole scan, else those that confirm a candidate of the plan; of their own job, if answers have a job_id."""
    own = [k for k in ("job_id",) if k in answers.columns]
    span = ["video_id", *own, "start_ms", "end_ms"]
    a = answers.join(plan.select("video_id", "kind").distinct(), "video_id")
    jobs = plan.filter("start_ms is not null").select(span)
    asked = a.filter("kind <> 'fallback'")
    met = meeting(jobs, asked.select("video_id", *(F.col(k).alias(f"r_{k}") for k in own), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")))
    for k in own:
        met = met.filter(F.col(k) == F.col(f"r_{k}"))
    confirming = met.filter(matches_candidate(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")))
    confirming = confirming.select("video_id", *own, F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")).distinct()
    return a.filter("kind = 'fallback'").unionByName(asked.join(confirming, span, "left_semi").select(a.columns)).drop("kind")


def deliver(videos: DataFrame, community: DataFrame, local: DataFrame, answers: DataFrame, failed: DataFrame, blocked: DataFrame | None = None, trims: tuple[Column | None, Column | None] | None = None) -> DataFrame:
    """Segments as they are delivered: (video_id, start_ms, end_ms, source, confidence, reason, auto_skip, model).

    videos: (video_id, mode), with handle if there are blocked channels (handle), whose videos get
    nothing, and with llm where the model is off for some: these get all their local segments. failed: (video_id)
    whose model call failed. A hit delivers the community's segments. Without a plan the local
    ones go out under the mode's name. What the model verified replaces what was planned, unless
    it has nothing to say: then the sure long segments that needed no verification stay. After a
    failed call all sure segments go out. With trims, in seconds or null for the default, edges are cut.
    What several steps read is a table.
    """
    if blocked is not None:
        videos = settled(drop_blocked(videos, blocked), "open")
    asked = with_hits(videos, community)
    plan = llm_plan(videos.filter("llm") if "llm" in videos.columns else videos, local, community)
    plan = settled(numbered_jobs(plan) if "job_id" in answers.columns else plan, "plan")
    own = local.join(asked.filter("not hit and mode <> 'sponsorblock-only'").select("video_id", F.col("mode").alias("source")), "video_id")
    own = settled(own, "own")
    planned, lost = plan.select("video_id", "kind").distinct(), failed.select("video_id").distinct()
    answered = planned.join(lost, "video_id", "left_anti")
    accepted = normalize_segments(accepted_answers(answers, plan).join(answered.select("video_id"), "video_id", "left_semi").withColumn("source", F.lit("llm-fallback")), "llm-fallback")
    accepted = settled(accepted, "accepted")
    mixed = combine_verified(own, accepted, plan.join(lost, "video_id", "left_anti"))
    spoken = mixed.select("video_id").distinct().join(answered.filter("kind = 'candidate-verification'"), "video_id").select("video_id").union(accepted.select("video_id")).distinct()
    mixed, spoken = settled(mixed, "mixed"), settled(spoken, "spoken")
    verified = mixed.join(spoken, "video_id", "left_semi")
    mine = verified.filter("origin = 'local'").join(own.drop("source"), ["video_id", "start_ms", "end_ms"], "left_semi").join(own.select("video_id", "start_ms", "end_ms", *(c for c in ("confidence", "reason") if c in own.columns)), ["video_id", "start_ms", "end_ms"]).withColumn("source", F.lit("llm-fallback"))
    sure = own.filter("confidence = 'high'").join(planned.join(lost, "video_id", "left_semi"), "video_id", "left_semi")
    silent = deliverable(own).join(answered, "video_id", "left_semi").join(spoken, "video_id", "left_anti")
    alone = own.join(planned, "video_id", "left_anti")
    cols = ["video_id", "start_ms", "end_ms", "source", *(c for c in ("confidence", "reason") if c in own.columns)]
    found = mine.select(cols).unionByName(sure.select(cols)).unionByName(silent.select(cols)).unionByName(alone.select(cols))
    theirs = accepted.join(spoken, "video_id", "left_semi")
    hits = community.join(asked.filter("hit").select("video_id"), "video_id", "left_semi")
    out = normalize_segments(found.unionByName(theirs.select(theirs.columns), allowMissingColumns=True), "local").unionByName(normalize_segments(hits, "sponsorblock"))
    return out if trims is None else trim_segments(out, *trims)
