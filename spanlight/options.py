"""Thresholds of detection, in milliseconds where they are times."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorOptions:
    max_segment: float = 180_000
    min_segment: float = 8_000
    evidence_window: float = 50_000
    search_back: float = 30_000
    lead_in_back: float = 25_000
    max_span_events: int = 4
    max_span: float = 8_000
    merge_gap: float = 8_000
    stay_window: float = 20_000
    stay_score: int = 3
    strong_grace: float = 12_000
    end_pending_after: float = 8_000
    no_evidence: float = 15_000
    explicit_no_evidence: float = 30_000
    explicit_initial: float = 60_000
    self_promotion_no_evidence: float = 150_000
    tail: float = 4_000
    topic_lookback: float = 30_000
    topic_window: float = 9_000
    topic_cosine: float = 0.24
    topic_jaccard: float = 0.16
    brand_window: float = 90_000
    entry_score: int = 12
    categories: tuple[str, ...] = ("paid-sponsor", "affiliate", "commercial-unknown", "self-promotion")
