"""Reads: how far the promotion around a seed goes.

Captions far from any seed decide nothing, so Spark cuts every video into stretches (see
`stretches`) and each stretch is worked on by itself. Inside one, all evidence is laid out as
arrays over the captions: what was last seen up to each of them, and how long ago. Every rule
that can end a read names the first caption at which it holds, and the earliest one ends it.
Only the choice among seeds is sequential, since a read hides the seeds inside it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import DetectorOptions
from ..patterns import NEGATIVES, PRECISE, WEIGHTS

SEGMENT = "start_ms double, end_ms double, confidence string, category string, reason string, score int, groups array<string>, brands array<string>"
COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]
GROUPS, AGAINST = tuple(WEIGHTS), tuple(NEGATIVES)
POINTS = np.array([WEIGHTS[g] for g in GROUPS])
PRECISE_MASK = sum(1 << GROUPS.index(g) for g in PRECISE)
SPONSOR, AFFILIATE = (1 << GROUPS.index(g) for g in ("sponsor", "affiliate"))
#: Points by which a score must exceed the entry score where a read has little else to show.
MARGIN = 8


def bits(names: F.Column, known: tuple[str, ...]) -> F.Column:
    """A set of names as a number with a bit for each."""
    return sum((F.when(F.array_contains(names, g), 1 << k).otherwise(0) for k, g in enumerate(known)), F.lit(0)).cast("int")


def stretches(rows: DataFrame, options: DetectorOptions = DetectorOptions()) -> DataFrame:
    """The captions that some seed can reach, with stretch: a number such that no seed reaches into another stretch.

    rows: (video_id, event_idx, start_ms, end_ms, seeded). A seed reaches back by the search and
    the topic before it, and ahead by the longest segment; captions are whole, so one that is
    long ties together what it touches.
    """
    ahead, back = options.max_segment, options.search_back + options.topic_lookback
    order = W.partitionBy("video_id").orderBy("event_idx")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    seed = F.when(F.col("seeded"), F.col("start_ms"))
    reverse = W.partitionBy("video_id").orderBy(F.col("event_idx").desc()).rowsBetween(W.unboundedPreceding, 0)
    near = rows.withColumn("__last", F.last(seed, ignorenulls=True).over(so_far)).withColumn("__next", F.last(seed, ignorenulls=True).over(reverse))
    before = F.coalesce(F.col("__next") - back <= F.col("end_ms"), F.lit(False))
    near = near.filter(before | (F.col("start_ms") - F.col("__last") <= ahead))
    low = F.least("start_ms", F.when(before, F.col("__next") - back))
    reach = F.max(F.greatest("end_ms", F.when(F.col("seeded"), F.col("start_ms") + ahead))).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.coalesce(reach < low, F.lit(True)), 1).otherwise(0)
    return near.withColumn("__opens", opens).withColumn("stretch", F.sum("__opens").over(so_far)).drop("__last", "__next", "__opens")


@dataclass
class Seed:
    """Captions at which a read seems to start or to be dense; positions in the stretch."""

    start: int
    end: int
    explicit: bool
    score: int
    endorses: bool = False
    strong: bool = False
    contextual: bool = False
    own: bool = False


def latest(flags: np.ndarray) -> np.ndarray:
    """For every position the last one up to it that is set, or -1; along the last axis."""
    return np.maximum.accumulate(np.where(flags, np.arange(flags.shape[-1]), -1), axis=-1)


class Stretch:
    def __init__(self, rows: pd.DataFrame, options: DetectorOptions):
        self.options = options
        column = lambda c, kind: rows[c].to_numpy(kind)
        self.start, self.end, self.next = (column(c, float) for c in ("start_ms", "end_ms", "next_ms"))
        self.index = column("event_idx", np.int64)
        self.masks, self.against = column("mask", np.int64), column("against", np.int64)
        self.evidence, self.evidence_next = column("commercial", np.int64), column("next_commercial", np.int64)
        self.opens, self.sells, self.sells_start = (column(c, bool) for c in ("starts", "self_promotion", "self_promotion_start"))
        self.affiliate, self.lead_in, self.pre_roll = (column(c, bool) for c in ("affiliate", "lead_in", "pre_roll"))
        self.brands, self.words, self.closings = rows["brands"].tolist(), rows["words"].tolist(), rows["end_spans"].tolist()
        precise = self.masks & PRECISE_MASK > 0
        self.precise_at, self.fed_at = latest(precise), latest(self.evidence >= 1)
        self.strong_at = latest(self.opens | (self.evidence >= 4) | precise)
        counted = np.where(self.evidence > 0, self.masks, 0)
        self.group_at = latest(counted >> np.arange(len(GROUPS))[:, None] & 1 > 0)
        self.reached = np.maximum.accumulate(self.end)
        self.closing = np.array([len(x) > 0 for x in self.closings], bool)
        self.seeds = [Seed(k, self.position(s["end"]), True, s["score"], s["endorsement"], s["strong"], s["contextual"], s["self_start"]) for k, xs in enumerate(rows["start_spans"]) for s in xs]
        self.spans = list(self.seeds)
        self.seeds += [Seed(k, self.position(w["end"]), False, w["score"]) for k, xs in enumerate(rows["windows"]) for w in xs]
        self.seeds.sort(key=lambda s: (s.start, not s.explicit, -s.score, s.end))

    def position(self, index: int) -> int:
        """The position of a caption, by its number in the video."""
        return int(np.searchsorted(self.index, index))

    def back_to(self, position: int, length: float) -> int:
        """The first position at most so long before the given one."""
        return int(np.searchsorted(self.start, max(0.0, self.start[position] - length)))

    def topic(self, low: float, high: float) -> dict[str, float]:
        """Weights of the words of all captions that meet a time range."""
        counts: dict[str, list[float]] = {}
        for k in range(int(np.searchsorted(self.reached, low)), int(np.searchsorted(self.start, high, "right"))):
            if self.end[k] >= low:
                for w in self.words[k]:
                    counts.setdefault(w["token"], [0, w["idf"]])[0] += w["n"]
        return {t: (1 + math.log(n)) * idf for t, (n, idf) in counts.items()}

    def opening(self, seed: Seed) -> int:
        """Where the read around a seed starts: at talk that leads in to an endorsement, at a disclosure before a dense window, or at the seed."""
        o = self.options
        if seed.explicit:
            if not (seed.endorses or seed.strong):
                return seed.start
            low = self.back_to(seed.start, min(o.search_back, o.lead_in_back))
            cues = np.flatnonzero(self.lead_in[low : seed.start + 1]) + low
            return int(cues[0]) if len(cues) >= 2 else seed.start
        low = self.back_to(seed.start, o.search_back)
        disclosed = [s.start for s in self.spans if low <= s.start <= seed.end]
        rolls = np.flatnonzero(self.pre_roll[low : seed.start]) + low
        return max(disclosed) if disclosed else int(rolls[-1]) if len(rolls) else seed.start


def alike(a: dict[str, float], b: dict[str, float], options: DetectorOptions) -> bool:
    shared = a.keys() & b.keys()
    if len(shared) < 2:
        return False
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    least = sum(min(a[t], b[t]) for t in shared)
    cosine, jaccard = sum(a[t] * b[t] for t in shared) / norm, least / (sum(a.values()) + sum(b.values()) - least)
    return cosine >= options.topic_cosine and jaccard >= options.topic_jaccard


@dataclass
class Opening:
    """What is known about a read before its end is looked for."""

    first: int
    strong: bool
    contextual: bool
    own: bool
    sells_own: bool

    @property
    def explicit(self) -> bool:
        return self.strong or self.contextual or self.own


def opening_of(v: Stretch, seed: Seed) -> Opening:
    first = v.opening(seed)
    told = [s for s in v.spans if s.start == first and s.end <= max(seed.end, first + 3)] + [seed] * seed.explicit
    until = max(seed.end, first) + 1
    sells = (v.sells | v.sells_start)[first:until] & (v.masks[first:until] & SPONSOR == 0)
    return Opening(first, any(s.strong for s in told), any(s.contextual for s in told), any(s.own for s in told), bool(sells.any()))


@dataclass
class Ending:
    """The last caption looked at; the time of the end, or the last caption inside; how it was found."""

    seen: int
    end_ms: float | None
    last: int
    reason: str = "low-evidence-timeout"

    @property
    def bounded(self) -> bool:
        return self.reason == "explicit-boundary"


def ending_of(v: Stretch, seed: Seed, read: Opening) -> Ending:
    o, first = v.options, read.first
    begin, limit = v.start[first], v.start[first] + o.max_segment
    at = np.arange(first, int(np.searchsorted(v.start, limit, "right")))
    fed, sure = np.maximum(v.fed_at[at], first), np.maximum(v.strong_at[at], first)
    start, end = v.start[at], v.end[at]
    front = np.maximum(start, np.minimum(end, v.next[at]))
    idle, doubt = np.maximum(0, front - v.end[fed]), np.maximum(0, front - v.end[sure])

    # The rolling window's left edge never moves back; a group counts while its last caption is inside.
    edge = np.maximum.accumulate(np.clip(np.searchsorted(v.start, end - o.stay_window), first, at))
    steady = POINTS @ (v.group_at[:, at] >= edge)
    runs_on = (v.next[at] < end) & (v.evidence_next[at] > 0)
    busy = (v.evidence[at] > 0) | runs_on | (steady >= o.stay_score) | (doubt < o.strong_grace)
    if not seed.explicit:
        busy |= at <= seed.end
    pending = latest(~busy & (idle >= o.end_pending_after)) > latest(busy)

    if read.sells_own:
        patience = np.full(len(at), o.self_promotion_no_evidence)
    elif read.explicit:
        patience = np.where(v.precise_at[at] >= first, o.explicit_no_evidence, o.explicit_initial)
    else:
        patience = np.full(len(at), o.no_evidence)
    apart = ~((seed.start <= at) & (at <= seed.end)) if seed.explicit else np.ones(len(at), bool)

    def first_of(flags: np.ndarray) -> int:
        return int(np.argmax(flags)) if flags.any() else len(at)

    other = first_of(np.r_[False, pending[:-1]] & v.opens[at] & apart)
    closed = first_of(np.array([v.closing[k] and v.end[k] - begin >= o.min_segment and any(s["start"] >= v.index[first] for s in v.closings[k]) for k in at], bool))
    waiting = pending & ~busy
    silent = first_of(waiting & (idle >= patience))
    if waiting.any() and (read.sells_own or not read.explicit):
        before = v.topic(max(0.0, begin - o.topic_lookback), max(0.0, begin - 1))
        for k in np.flatnonzero(waiting[: min(other, closed, silent + 1)]) if before else ():
            since = end[k] - o.topic_window
            if alike(before, v.topic(since, end[k]), o):
                back = int(np.argmax(v.end >= since))
                return Ending(int(at[k]), None, max(first, back - 1), "topic-resumption")

    k = min(other, closed, silent)
    if k == len(at):
        seen = int(at[-1])
        return Ending(seen, min(v.end[seen], v.end[fed[-1]] + o.tail, limit), seen)
    seen = int(at[k])
    if other == k:
        return Ending(seen, min(v.end[fed[k - 1]] + o.tail, start[k]), seen)
    if closed == k:
        span = max((s for s in v.closings[seen] if s["start"] >= v.index[first]), key=lambda s: s["start"])
        before_ms = v.start[v.position(span["start"])] if span["before"] else None
        return Ending(seen, before_ms, seen, "explicit-boundary")
    return Ending(seen, min(v.end[fed[k]] + o.tail, limit), seen)


def points(mask: int) -> int:
    return sum(int(p) for k, p in enumerate(POINTS) if mask >> k & 1)


def credible(read: Opening, mask: int, against: int, entry: int) -> bool:
    """Whether what a read holds is enough, and not speech about promotion."""
    about, discussed = (any(against >> AGAINST.index(g) & 1 for g in names) for names in (("explicitNegation", "exampleOrMeta"), ("productDiscussion",)))
    score = points(mask)
    backed = score >= entry and mask.bit_count() >= 2 and mask & PRECISE_MASK > 0
    weighs = read.strong or score >= entry + MARGIN
    return (bool(mask & AFFILIATE) or not about) and (weighs or not discussed) and (backed or read.strong or read.own)


def category_of(read: Opening, mask: int, promotes: bool, affiliate: bool, branded: bool) -> str:
    sponsor = mask & SPONSOR
    if promotes and not affiliate and not sponsor:
        return "self-promotion"
    if read.explicit:
        return "paid-sponsor"
    if affiliate and not sponsor:
        return "affiliate"
    return "paid-sponsor" if sponsor or branded and mask & PRECISE_MASK else "commercial-unknown"


def read_of(v: Stretch, seed: Seed) -> tuple | None:
    """A row of COLUMNS, or None where the evidence inside does not hold."""
    read = opening_of(v, seed)
    found = ending_of(v, seed, read)
    inside = slice(read.first, found.seen + 1)
    keep = v.start[inside] < found.end_ms if found.end_ms is not None else np.arange(read.first, found.seen + 1) <= found.last
    mask, against = (int(np.bitwise_or.reduce(x[inside][keep], initial=0)) for x in (v.masks, v.against))
    if not credible(read, mask, against, v.options.entry_score):
        return None
    brands = sorted({b for b_s, k in zip(v.brands[inside], keep) if k for b in b_s})
    score = points(mask)
    category = category_of(read, mask, bool(v.sells[inside][keep].any()), bool(v.affiliate[inside][keep].any()), bool(brands))
    sure = "high" if found.bounded else "medium" if read.explicit or score >= v.options.entry_score + MARGIN else "low"
    reason = f"explicit-start+{found.reason}" if read.explicit and not found.bounded else found.reason
    end_ms = v.end[found.last] if found.end_ms is None else found.end_ms
    return v.start[read.first], end_ms, sure, category, reason, score, sorted(g for k, g in enumerate(GROUPS) if mask >> k & 1), brands


def reads(options: DetectorOptions):
    """For applyInPandas over a stretch: all its reads."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = Stretch(rows.sort_values("event_idx", ignore_index=True), options)
        found: list[tuple] = []
        for seed in v.seeds:
            at = v.start[seed.start]
            if not any(low <= at <= high for low, high, *_ in found) and (row := read_of(v, seed)):
                found.append(row)
        return pd.DataFrame(found, columns=COLUMNS).assign(video_id=rows["video_id"].iloc[0])[["video_id", *COLUMNS]]

    return run
