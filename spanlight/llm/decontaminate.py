"""Benchmark decontamination by spaced-seed hashing.

A mask of up to nine token positions of which four or five count is laid on every position of a
text; the hash of the counting tokens ignores substitutions at the others. Several fixed masks
together meet an overlap that carries a substituted token every few words, whether these come
at random or every second, third, fourth or fifth word. Texts are joined with the benchmark on these hashes. One hit of
so few tokens says little, so two on one diagonal are asked for; then both sides are compared token by token along
that diagonal. If at least MIN_SHARE of the diagonal's positions match, the overlap runs
from its first match to its last; else it is the best run of matches, in which a substitution
costs as much as two matches earn.

A document is contaminated by an item if its best overlap has MIN_MATCHED matching tokens
and covers MIN_SHARE of the item's tokens, or has LONG_MATCHED of them at any share. Items
below MASKED_ITEM tokens are looked up whole, and by halves where a substitution still leaves
MIN_MATCHED; those below MIN_ITEM tokens are too common to tell anything inside a text and meet
only texts that consist of them. Tokens are lower-cased words without leading and
trailing ASCII punctuation.

Tasks pack the benchmark into parts: the hashes of its tokens, and the sorted hashes of every
mask position. Spark hands the parts to every executor once, workers map them into memory, and
the texts are read once, against all parts. A part has a bounded number of tokens, so no heap
holds the benchmark. Hits are found where the texts lie: no text and no
candidate is shuffled. A hash that many items share, as a common question's first words, gives many hits; these are
counted and compared as arrays, at most SLICE at a time. Tokens are equal by their 64-bit hashes.

Null and empty texts or items meet nothing. Repeated rows, and repeated ids, are judged row
by row; item rows that repeat as a whole are packed once and give as many rows. Texts are taken whole. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, n_words
from .mapped import handed, hand_out, opened, pack

#: Fixed masks: each but the first and the last three leaves out one of every two to five tokens.
MASKS = ("11111", "101010101", "1101101", "111011", "111101", "1011001", "1100101", "11010001")
#: Items from so many tokens on are met by masks, twice on a diagonal.
MASKED_ITEM = 12
HITS = 2
#: Hits and tokens that are counted or compared at a time.
SLICE = 1 << 20
MIN_ITEM = 5
MIN_MATCHED = 10
MIN_SHARE = 0.5
LONG_MATCHED = 30
#: A substitution inside an overlap costs so many matches.
PENALTY = 2
#: Tokens of benchmark text in one part, about: 8 masks x 16 bytes each, 64 MB.
BLOCK_TOKENS = 500_000
#: Tokens of texts that are looked up together, about.
TOGETHER = 1 << 17
#: Distinct tokens whose hashes a task remembers.
REMEMBERED = 1_000_000
PUNCTUATION = b".,;:!?\"'()[]{}<>-_*#%&$|/\\`~"
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    return [w for x in text.lower().split() if (w := x.strip(PUNCTUATION))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the counting tokens at every position that the mask fits on."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, x in enumerate(mask):
        if x == "1":
            out = out * ODD + h[k : k + n]
    return _mixed(out)


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of all matches if they are MIN_SHARE of the positions, else of the run with the best sum of matches less PENALTY a substitution."""
    at = np.flatnonzero(same)
    if len(at) and len(at) >= MIN_SHARE * len(same):
        return int(at[0]), int(at[-1]) + 1, len(at)
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


class Hashes(dict):
    """Token hashes, remembered up to a number of tokens."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def masks_of(size: int, masks: tuple[str, ...]) -> list[str]:
    """The masks that an item of so many tokens is looked up by."""
    if size < MIN_ITEM:
        return []
    if size < MASKED_ITEM:
        return [h * "1" for h in {size, size // (size - MIN_MATCHED + 1) if size > MIN_MATCHED else size}]
    return list(masks)


def packed(ids: pa.Array, texts: list[bytes], copies: np.ndarray, masks: tuple[str, ...]) -> bytes:
    """The items as one payload: ids, copies, tokens with the items' edges, and sorted hashes of each mask."""
    known = Hashes()
    codes = [known.of(tokens(t)) for t in texts]
    held = [i for i, c in enumerate(codes) if len(c)]
    codes = [codes[i] for i in held]
    sink = pa.BufferOutputStream()
    own = ids.take(pa.array(held, pa.int64()))
    with pa.ipc.new_stream(sink, pa.schema([("id", own.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([own], names=["id"]))
    arrays = {
        "ids": np.frombuffer(sink.getvalue(), np.uint8),
        "copies": copies[held],
        "codes": np.concatenate(codes) if codes else np.zeros(0, np.uint64),
        "edges": np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int64),
    }
    places: dict[str, list[int]] = {}
    for i, c in enumerate(codes):
        for m in masks_of(len(c), masks) or ["whole"]:
            places.setdefault(m, []).append(i)
    for m, items in places.items():
        # Items below MIN_ITEM are found by the hash of all their tokens.
        each = [masked(codes[i], "1" * len(codes[i]) if m == "whole" else m) for i in items]
        h, of, at = np.concatenate(each), np.repeat(items, [len(x) for x in each]), np.concatenate([np.arange(len(x)) for x in each])
        order = np.argsort(h, kind="stable")
        near = np.zeros(1 << 20, bool)
        near[h >> np.uint64(44)] = True
        arrays |= {f"h {m}": h[order], f"of {m}": of[order].astype(np.int32), f"at {m}": at[order].astype(np.int32), f"near {m}": near}
    return pack(arrays)


class Part:
    """A mapped part of the benchmark."""

    def __init__(self, path: str):
        x = opened(path)
        self.ids = pa.ipc.open_stream(pa.py_buffer(x["ids"])).read_all().column("id").combine_chunks()
        self.copies, self.codes, self.edges = x["copies"], x["codes"], x["edges"]
        self.tables = {k[2:]: (x[k], x["of" + k[1:]], x["at" + k[1:]], x["near" + k[1:]]) for k in sorted(x) if k.startswith("h ")}

    def item(self, i: int) -> np.ndarray:
        return self.codes[self.edges[i] : self.edges[i + 1]]

    def _met(self, m: str, x: np.ndarray) -> Iterator[np.ndarray]:
        """Every place where a hash of the text equals one of the mask's, as item and shift in one number; some at a time."""
        table, of, at, near = self.tables[m]
        places = np.flatnonzero(near[x >> np.uint64(44)])
        low, high = np.searchsorted(table, x[places], "left"), np.searchsorted(table, x[places], "right")
        hit = high > low
        places, low, n = places[hit], low[hit], (high - low)[hit]
        upto = np.cumsum(n)
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] - n[first] + SLICE, "right")))
            own = n[first:last]
            j = np.repeat(low[first:last] - np.cumsum(own) + own, own) + np.arange(own.sum())
            yield (of[j].astype(np.int64) << 32) + (np.repeat(places[first:last], own) - at[j]) + (1 << 31)
            first = last

    def touched(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which of many texts, laid end to end with these edges, have a hit, or are short enough to be an item as a whole."""
        out = np.diff(edges) < MIN_ITEM
        for m, (table, _, _, near) in self.tables.items():
            if m == "whole" or not len(table):
                continue
            x = masked(codes, m)
            places = np.flatnonzero(near[x >> np.uint64(44)])
            at = np.minimum(np.searchsorted(table, x[places]), len(table) - 1)
            places = places[table[at] == x[places]]
            text = np.searchsorted(edges, places, "right") - 1
            out[text[places + len(m) <= edges[text + 1]]] = True
        return out

    def _diagonals(self, codes: np.ndarray) -> np.ndarray:
        """Items and shifts of the diagonals with hits enough, as numbers in order."""
        seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for m in self.tables:
            if m == "whole":
                continue
            for pairs in self._met(m, masked(codes, m)):
                pairs, n = np.unique(pairs, return_counts=True)
                seen, back = np.unique(np.concatenate((seen, pairs)), return_inverse=True)
                times = np.bincount(back, np.concatenate((times, n)), len(seen)).astype(np.int64)
        sizes = np.diff(self.edges)[seen >> 32]
        return seen[(times >= HITS) | (sizes < MASKED_ITEM)]

    def _compared(self, codes: np.ndarray, items: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, matches, start, end) of the diagonals that are long enough in matches."""
        begin, size = self.edges[items], np.diff(self.edges)[items]
        first, last = np.maximum(0, -shifts), np.minimum(size, len(codes) - shifts)
        n = last - first
        ends = np.cumsum(n)
        own = np.repeat(begin + first - ends + n, n) + np.arange(n.sum())
        text = np.repeat(first + shifts - ends + n, n) + np.arange(n.sum())
        same = self.codes[own] == codes[text]
        total = np.add.reduceat(same.astype(np.int64), ends - n)
        # A run of matches has at most as many as its diagonal.
        for k in np.flatnonzero((total >= LONG_MATCHED) | (total >= np.minimum(MIN_MATCHED, size)) & (total >= MIN_SHARE * size)).tolist():
            start, end, matches = best_run(same[ends[k] - n[k] : ends[k]])
            at = int(first[k] + shifts[k])
            yield int(items[k]), matches, at + start, at + end

    def overlaps(self, codes: np.ndarray) -> list[tuple]:
        """(item, matches, start, end) of the best overlap with each item that the text, as token hashes, meets; the first of those that tie."""
        if len(codes) < MIN_ITEM:
            if not len(codes) or "whole" not in self.tables:
                return []
            items = np.unique(np.concatenate([x >> 32 for x in self._met("whole", masked(codes, "1" * len(codes)))] or [np.zeros(0, np.int64)]))
            return [(int(i), len(codes), 0, len(codes)) for i in items if np.array_equal(self.item(i), codes)]
        pairs = self._diagonals(codes)
        items, shifts = pairs >> 32, (pairs & ((1 << 32) - 1)) - (1 << 31)
        upto = np.cumsum(np.diff(self.edges)[items]) if len(items) else np.zeros(0, np.int64)
        best: dict[int, tuple] = {}
        first = 0
        while first < len(items):
            base = int(upto[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(upto, base + SLICE, "right")))
            for found in self._compared(codes, items[first:last], shifts[first:last]):
                if found[0] not in best or (found[1], -found[2]) > (best[found[0]][1], -best[found[0]][2]):
                    best[found[0]] = found
            first = last
        out = []
        for i, found in sorted(best.items()):
            n, size = found[1], int(self.edges[i + 1] - self.edges[i])
            if n >= LONG_MATCHED or n >= min(MIN_MATCHED, size) and n >= MIN_SHARE * size:
                out.append(found)
        return out


def parts_of(benchmark: DataFrame, item_id: str, text: str, masks: tuple[str, ...], most: int) -> list[str]:
    """Writes the items in parts of about so many tokens (an item alone may have more), and hands their files out."""
    items = benchmark.filter(F.col(text).isNotNull()).groupBy(F.col(item_id).alias("id"), F.col(text).alias("item")).agg(F.count("*").alias("copies"))
    total = benchmark.agg(F.sum(n_words(F.col(text)))).first()[0] or 0
    items = items.withColumn("part", F.expr(f"cast(pmod(xxhash64(id, item), {max(1, -(-total // most))}) as int)"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("item", "ascending")]).combine_chunks()
        payload = packed(t.column("id").combine_chunks(), [x or b"" for x in t.column("item").cast(pa.binary()).to_pylist()], t.column("copies").to_numpy(), masks)
        return pa.table({"part": t.column("part").slice(0, 1), "payload": pa.array([payload], pa.binary())})

    return hand_out(items.groupBy("part").applyInArrow(build, "part int, payload binary"), "benchmark")


def found_in(names: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]]:
    """In a task: each batch with the overlaps of its rows, as (part, item, matches, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
        parts, known = [Part(p) for _, p in sorted(handed(names).items())], Hashes()
        for b in batches:
            found: list[list[tuple]] = [[] for _ in range(b.num_rows)]
            rows, codes, held = [], [], 0
            for i, t in enumerate(as_bytes(b, text)):
                rows.append(i)
                codes.append(known.of(tokens(t)))
                held += len(codes[-1])
                if held >= TOGETHER or i + 1 == b.num_rows:
                    edges = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
                    end_to_end = np.concatenate(codes)
                    for p in parts:
                        for k in np.flatnonzero(p.touched(end_to_end, edges)).tolist():
                            found[rows[k]] += [(p, *x) for x in p.overlaps(codes[k])]
                    rows, codes, held = [], [], 0
            yield b, found

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """A row per document and item that overlap: doc_id, item_id, n_matched, n_item (tokens), start_token, end_token."""
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType
    schema = f"`{doc_id}` {kind}, `{item_id}` {item_kind.simpleString()}, n_matched long, n_item long, start_token long, end_token long"
    run = found_in(parts_of(benchmark, item_id, item_text, masks, block_tokens), text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in run(batches):
            flat = [(k, x) for k, own in enumerate(found) for x in own for _ in range(x[0].copies[x[1]])]
            ids = b.column(0).take(pa.array([k for k, _ in flat], pa.int64()))
            items = pa.array([p.ids[i].as_py() for _, (p, i, *_) in flat], type=_arrow(item_kind))
            numbers = [(n, len(p.item(i)), start, end) for _, (p, i, n, start, end) in flat]
            yield pa.RecordBatch.from_arrays([ids, items, *(column([x[c] for x in numbers], pa.int64()) for c in range(4))], names=[doc_id, item_id, "n_matched", "n_item", "start_token", "end_token"])

    return docs.select(doc_id, text).mapInArrow(rows, schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows that overlap no benchmark item, with all their columns; no shuffle."""
    run = found_in(parts_of(benchmark, item_id, item_text, masks, block_tokens), text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in run(batches):
            yield b.filter(column([not x for x in found], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
