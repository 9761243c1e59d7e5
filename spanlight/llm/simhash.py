"""SimHash near-duplicates with pigeonring filtering.

Fingerprints have 64 bits in four segments of 16, laid out as a ring. If two differ in at
most 3 bits, then from some segment on every chain of 1, 2 and 3 consecutive segments keeps
its proportional budget: at most 0, 1 and 2 differing bits. A start segment without a
difference, a next one with one at most and two in both next ones leave five choices of two
equal bytes among the four bytes of these next segments; so start segment and two bytes make
a 32-bit key, five for each of the four starts. Fingerprints that share a key are
candidates; the chains are checked on them first, the full distance last.

Equal fingerprints are one entry, so exact copies make no pairs. Entries with one key are
compared inside sorted partitions and give a spanning forest, not all pairs. Keys are counted
first, by partial aggregates. A key with more than BLOCK entries never meets in one task: its
bits that are still free are cut in four parts, of which three differing bits leave one equal,
and each part makes the key longer. After four such rounds at most eleven bits are free, so no
key can have more entries than BLOCK, whatever the data; no pair within three bits is lost.

Null texts and texts without words have fingerprint zero and link like any other. Rows that
repeat an id each get a row; a null id never is a component's name unless no other id is in it
(then component_id is null). Whole texts count. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, as_bytes, column, one_row_each, same
from .components import components

SEED = 42
DISTANCE = 3
#: Entries of one key that are compared inside one task; a key with more goes by pairs of blocks.
BLOCK = 2048
#: For each start segment, the bytes of the two next segments (two each) that make its keys.
BYTE_CHOICES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, digest, join = len(words) - shingle + 1, xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = words[at : min(n, at + 65536) + shingle - 1]
        parts = zip(*(part[k:] for k in range(shingle)))
        h = np.array([digest(join(x), SEED) for x in parts], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): a row per input row, fp as a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in as_bytes(b, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), column(fp, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fp long")


def chain_masks() -> list[int]:
    """The bits of each of the twenty keys: a start segment and two bytes of the two next segments."""
    bytes_of = lambda start: [16 * (start + 1) + 8 * k for k in range(4)]
    return [(0xFFFF << 16 * start) | sum(0xFF << bytes_of(start)[k] % 64 for k in choice) for start in range(4) for choice in BYTE_CHOICES]


def longer_masks(mask: int) -> list[int]:
    """The mask with each of four equal parts of its free bits."""
    free = [k for k in range(64) if not mask >> k & 1]
    return [mask | sum(1 << k for k in free[p::4]) for p in range(4)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(entries: DataFrame, masks: list[int]) -> DataFrame:
    """(key, mask, fp): the masked fingerprints; keys of different masks that meet by hash only add comparisons."""
    mask = F.explode(F.array(*(F.lit(_long(m)).cast("long") for m in masks))).alias("mask")
    return entries.select("fp", mask).select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask", "fp")


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs differ in at most DISTANCE bits: chains of the ring first, then the whole."""
    x = a ^ b
    parts = [np.bitwise_count((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int8) for k in range(4)]
    chained = np.zeros(len(x), bool)
    for k in range(4):
        sums, good = np.zeros(len(x), np.int8), np.ones(len(x), bool)
        for length in range(1, 4):
            sums = sums + parts[(k + length - 1) % 4]
            good &= sums <= length * DISTANCE // 4
        chained |= good
    at = np.flatnonzero(chained)
    chained[at] = np.bitwise_count(x[at]) <= DISTANCE
    return chained


class Forest:
    """Links between the entries of a batch, kept as a label per entry."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.at = np.unique(entries, return_inverse=True)
        self.label = np.arange(len(self.entries))

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Links rows of the batch by their positions."""
        a, b = self.at[left], self.at[right]
        while len(a):
            x, y = self.label[a], self.label[b]
            if not (x != y).any():
                return
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label != (up := self.label[self.label])).any():
                self.label = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.entries[out], self.entries[self.label[out]]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return start, np.diff(np.r_[start, len(keys)])


def _link_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside runs of equal keys."""
    start, n = _runs(keys)
    big = np.repeat(n > 1, n)
    keys, fps = keys[big], fps[big]
    forest, unsigned = Forest(fps), fps.view(np.uint64)
    d, left = 1, np.arange(len(keys))
    while len(left := left[left + d < len(keys)]) and len(left := left[keys[left] == keys[left + d]]):
        good = linked(unsigned[left], unsigned[left + d])
        forest.link(left[good], left[good] + d)
        d += 1
    return forest.edges()


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition sorted by key: edges (u, v) inside runs of equal keys. Holds a batch and a run at most."""

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(x, pa.int64()) for x in _link_runs(keys, fps)], schema=EDGES)

    keys = fps = np.zeros(0, np.int64)
    for b in batches:
        keys, fps = np.r_[keys, b.column(0).to_numpy()], np.r_[fps, b.column(1).to_numpy()]
        if len(keys):
            whole = int(_runs(keys)[0][-1])  # the last run may go on
            yield edges(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield edges(keys, fps)


def links(entries: DataFrame, staged: Staged) -> DataFrame:
    """Edges (u, v) whose components are those of all links between the distinct fp of entries."""
    masks, edges, level = chain_masks(), None, 0
    keyed = _keyed(entries, masks)
    while True:
        hot = staged.put(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key"), f"hot{level}", tidy=False)
        some = not hot.isEmpty()
        rest = keyed.join(hot, "key", "left_anti") if some else keyed
        found = rest.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link_sorted, "u long, v long")
        edges = found if edges is None else edges.union(found)
        if not some:
            return edges
        level += 1
        parts = F.create_map(*(x for m in masks for x in (F.lit(_long(m)).cast("long"), F.array(*(F.lit(_long(y)).cast("long") for y in longer_masks(m))))))
        masks = sorted({y for m in masks for y in longer_masks(m)})
        over = staged.put(keyed.join(hot, "key", "left_semi").select("fp", F.explode(parts[F.col("mask")]).alias("mask")).distinct(), f"over{level}", tidy=False)
        keyed = over.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask", "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """A row per input row: doc_id, fingerprint (hex) and component_id, the smallest id that links reach."""
    staged = Staged(docs.sparkSession, "simhash")
    prints = staged.put(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    entries = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(links(entries.select("fp"), staged), staged)
    rooted = entries.join(found, entries.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select(F.col("doc_id").alias(doc_id), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the smallest id; of rows that repeat it, see one_row_each."""
    found = near_duplicates(docs, doc_id, text, shingle)
    first = found.filter(same(F.col(doc_id), F.col("component_id"))).groupBy(doc_id).agg(F.count("*").alias("n"))
    return one_row_each(docs, first, doc_id)
