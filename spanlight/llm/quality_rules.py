"""Quality rules: repetition measures and compression bands.

A text passes if its size over its zstandard size lies inside a band for its length, and so
do its pieces: fixed chunks, of which a share may lie a little outside but none far outside,
and what is left behind the last full chunk (its last bytes, tail_bytes at least, so that the
rest of a chunk is judged however short). Repetitive text compresses too well, random text
hardly at all. The bands depend on the length because a longer text gives the compressor more
to refer to.

Null texts and texts without words have all measures 0 and fail the base rule (too few
words). Any id is passed through, null and repeated ones too: rows are judged one by one.
Whole texts are measured, whatever their length. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import SEPARATORS, as_bytes, column

SYMBOLS = "#*$%&|<>"

#: Up to so many UTF-8 bytes, the least and the largest ratio of a text. The least
#: lie between base64 in five-letter words at the upper length (1.11 at 256 bytes, 1.25 at 512,
#: 1.33 at 1024, 1.37 at 2048, 1.39 at 4096) and the prose that is labelled good at the lower one
#: (at least 1.15 at 192 bytes, 1.32 at 384, 1.52 at 768, 1.66 at 1024, 1.89 at 2048). Up to 192
#: bytes both overlap. A line that repeats goes far beyond the upper limits.
BANDS = (
    (192, 1.00, 2.6),
    (256, 1.13, 2.6),
    (384, 1.21, 2.6),
    (512, 1.28, 2.6),
    (768, 1.34, 2.9),
    (1024, 1.45, 2.9),
    (2048, 1.55, 3.2),
    (4096, 1.65, 3.5),
    (16384, 1.70, 3.8),
    (65536, 1.70, 4.2),
    (None, 1.70, 5.0),
)


@dataclass(frozen=True)
class QualityOptions:
    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    chunk_bytes: int = 4096
    chunk_low: float = 1.70
    chunk_high: float = 3.5
    #: No full chunk may lie outside these.
    far_low: float = 1.55
    far_high: float = 5.0
    tail_bytes: int = 1024
    #: The share of a text's full chunks that may lie outside the chunk band.
    chunk_share: float = 0.2


MEASURES = pa.schema(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("ratio", pa.float64()),
        ("bad_chunks", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
    ]
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    where = np.fromiter((first.setdefault(w, i) for i, w in enumerate(windows)), np.int64, len(windows))
    again = np.bincount(where, minlength=len(windows))[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def band(size: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in BANDS if most is None or size <= most)


def measure(text: bytes, options: QualityOptions, press: zstandard.ZstdCompressor) -> tuple:
    words, chars = text.split(), text.decode()
    word_chars = len(chars) - sum(map(chars.count, SEPARATORS))
    symbols = sum(map(chars.count, SYMBOLS))
    repeats = repeat_words(words)
    failed = len(words) < options.min_words or 100 * repeats > options.max_repeat_percent * len(words)
    ratio, bad, far, kept = 0.0, 0, False, False
    if text:
        ratio = len(text) / len(press.compress(text))
        low, high = band(len(text))
        n = options.chunk_bytes
        full = len(text) // n if len(text) > n else 0
        for i in range(full):
            x = n / len(press.compress(text[i * n : i * n + n]))
            bad += not options.chunk_low <= x <= options.chunk_high
            far |= not options.far_low <= x <= options.far_high
        kept = not failed and low <= ratio <= high and not far and bad <= options.chunk_share * full
        if full and len(text) % n:
            tail = text[-max(len(text) % n, options.tail_bytes) :]
            low, high = band(len(tail))
            outside = not low <= len(tail) / len(press.compress(tail)) <= high
            bad += outside
            kept = kept and not outside
    return len(words), word_chars, symbols, dup_lines(text), repeats, ratio, bad, failed, kept


def _measured(batch: pa.RecordBatch, text: str, options: QualityOptions, press) -> pa.RecordBatch:
    rows = [measure(x, options, press) for x in as_bytes(batch, text)]
    columns = zip(*rows) if rows else [[] for _ in MEASURES]
    return pa.RecordBatch.from_arrays([column(list(x), f.type) for x, f in zip(columns, MEASURES)], schema=MEASURES)


def measure_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: QualityOptions = QualityOptions()) -> DataFrame:
    """A row per input row: its id, the measures, and whether it is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=options.level)
        for b in batches:
            m = _measured(b, text, options, press)
            yield pa.RecordBatch.from_arrays([b.column(0), *m.columns], names=[doc_id, *m.schema.names])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks long, base_failed boolean, kept boolean"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, text: str = "text", options: QualityOptions = QualityOptions()) -> DataFrame:
    """The rows that the rules keep, with all their columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=options.level)
        for b in batches:
            yield b.filter(_measured(b.select([text]), text, options, press).column("kept"))

    return docs.mapInArrow(run, docs.schema)
