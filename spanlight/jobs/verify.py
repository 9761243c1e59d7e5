"""Verification by a language model as a job that can go on where it stopped.

Two rounds: the chunks of every job, then the captions around the seams that answers of the first
round touch. Requests are known by the hash of their text; answers are kept in a ledger, a
table that grows by whole batches. What the ledger has a good answer for is never sent again, so a
run after a failure sends only what is unanswered, and equal requests are sent once. The model
itself is the user's: a function from requests to responses.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import CHUNK_CHARS, OVERLAP_MS
from ..operators.requests import SEAM_MS, SEAM_TASK, answer_items, candidate_hints, chunk_lines, format_lines, job_chunks, job_ranges, llm_requests, parse_answers, replace_seam_segments, seam_centers, seam_edges, seam_ranges
from ..sources.committed import CommittedTable
from ..sources.tables import settled

#: (request_key, request) -> (request_key, payload) or (request_key, payload, error); what it leaves out has no answer.
Scorer = Callable[[DataFrame], DataFrame]
LEDGER = "request_key string, payload string, error string"
KEYS = ["job_id", "chunk_id"]


@dataclass(frozen=True)
class Verified:
    #: (video_id, job_id, start_ms, end_ms, confidence, category, reason): merged answers of videos without a failed request.
    answers: DataFrame
    #: (video_id): videos of which a request has no good answer.
    failed: DataFrame
    #: (video_id, job_id, chunk_id, round, error): those requests.
    errors: DataFrame


def ledger(spark, path: str) -> CommittedTable:
    return CommittedTable(spark, path, LEDGER)


def answered(requests: DataFrame, scorer: Scorer, kept: CommittedTable) -> DataFrame:
    """The requests (video_id, job_id, chunk_id, request) with payload and error: null if the answer is good, else why not.

    Sends what the ledger has no good answer for, and notes what comes back before anything reads it.
    """
    keyed = settled(requests.withColumn("request_key", F.sha2("request", 256)), "requests")
    known = kept.read().filter("error is null").select("request_key")
    todo = settled(keyed.select("request_key", "request").dropDuplicates(["request_key"]).join(known, "request_key", "left_anti"), "unanswered")
    if not todo.isEmpty():
        found = scorer(todo)
        said = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
        found = todo.select("request_key").join(found.select("request_key", "payload", said.alias("said")), "request_key", "left")
        wrong = answer_items(found, ["request_key", "payload", "said"])
        why = F.coalesce("said", F.when(F.col("payload").isNull(), "no answer"), "error")
        kept.add(wrong.select("request_key", "payload", why.alias("error")), uuid.uuid4().hex)
    best = kept.read().groupBy("request_key").agg(F.max_by(F.struct("payload", "error"), F.struct(F.col("error").isNull(), "payload", "error")).alias("a"))
    return keyed.join(best, "request_key", "left").select("video_id", *KEYS, "a.payload", F.when(F.col("a").isNull(), "no answer").otherwise(F.col("a.error")).alias("error"))


def verify(jobs: DataFrame, events: DataFrame, scorer: Scorer, kept: CommittedTable, model: str, most_chars: int = CHUNK_CHARS, overlap_ms: float = OVERLAP_MS, context_ms: float = SEAM_MS) -> Verified:
    """Asks the model about jobs (video_id, job_id, start_ms, end_ms, context_ms, confidence) of a plan; times are null for a whole video.

    events: (video_id, event_idx, start_ms, end_ms, text), numbered without gaps. A video whose
    requests are not all answered has no answers in this run; the next one asks again for what is missing.
    """
    lines = settled(format_lines(events), "lines")
    told = jobs.filter("start_ms is not null").select("video_id", "job_id", "start_ms", "end_ms", "confidence")

    def asked(chunks: DataFrame, task: str) -> DataFrame:
        texts = chunk_lines(chunks.select("video_id", *KEYS, "start_idx", "end_idx"), lines)
        requests = llm_requests(texts, candidate_hints(chunks, events, told, KEYS), model, KEYS, task)
        return settled(answered(requests, scorer, kept), "answers")

    chunks = settled(job_chunks(lines, job_ranges(jobs, events), most_chars, overlap_ms), "chunks")
    first = asked(chunks, "")
    lost = first.filter("error is not null").select("video_id").distinct()
    segments = settled(parse_answers(first.join(lost, "video_id", "left_anti"), chunks, events, KEYS), "segments")
    edges = settled(seam_edges(segments, chunks, events, ["job_id"]), "edges")
    seams = settled(seam_ranges(seam_centers(edges, ["job_id"]), events, context_ms, ["job_id"]).withColumnRenamed("seam", "chunk_id"), "seams")
    second = asked(seams, SEAM_TASK)
    errors = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2))).filter("error is not null")
    failed = errors.select("video_id").distinct()
    repaired = parse_answers(second.filter("error is null"), seams, events, KEYS)
    merged = replace_seam_segments(segments, edges, repaired, ["job_id"]).join(failed, "video_id", "left_anti")
    return Verified(merged, failed, errors.select("video_id", *KEYS, "round", "error"))
