"""Near-duplicates at a given similarity of sets: SimHash and pigeonring for candidates, then an exact check.

Two documents are linked if their sets of distinct shingles have a similarity of at least the
given one: the cosine, common shingles over the root of the product of the sizes, which is what SimHash
estimates, or Jaccard's. A cosine of s is a Jaccard similarity of s * s at least, so candidates
for it are looked for at that one. Groups are the components of these links.

Fingerprints alone cannot find the candidates at a similarity of 0.8: two texts then differ in
about 19 and up to 41 of 128 bits, so a chain of the ring may start with 5 differing bits of 16,
and keys for that are nearly all there are. So candidates share a key of their sketches, the
SKETCH smallest shingle hashes. Of these, `common_keys(similarity)` are in both sketches unless
by a chance of MISS, or of nothing for sets no larger than a sketch. Put in any one order, all
but that many less one of a sketch's keys hold one that both texts share; the order puts keys
that more than BLOCK sets have last, so a passage that a third of all texts share makes no
candidates among them as long as it is not most of a text.

Candidates pass the ring: of 128 fingerprint bits over the sets at most filter_bits(similarity)
differ, which a pair at the very similarity exceeds with a chance of MISS. The chains of the
ring of eight 16-bit segments come first (from some segment on, every chain of k segments
differs in at most k times the distance over eight), the full Hamming check after them; sizes
too far apart are left out.

What is left is only connected, not judged: inside each component of candidates the whole sets
of shingle hashes are intersected, all pairs of them. The sets come from the texts a second
time, only for documents that have a candidate.

Equal sets are one entry, known by a hash of the whole set, its size and its fingerprint. Keys
and components are counted by partial aggregates before anything is dealt by them. A key that
more than BLOCK entries keep, and a component with more than MOST_SETS, is dealt by blocks of
entries and compared by pairs of blocks in tasks of their own: exact, split over tasks, and
quadratic in that group.

Null texts and texts without words are one group, whose set is empty. Rows that repeat an id
each get a row; a null id is a component's name only if no other id is in it. Whole texts
count. Columns besides id and text do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, as_bytes, column, one_row_each, same
from .components import components
from .simhash import BLOCK, EDGES, SEED, Forest, _runs

SKETCH = 32
SEGMENTS = 8
#: The chance that a pair at the very similarity differs in more bits than the filter lets through.
MISS = 1e-6
#: Entries of a component of candidates whose sets are intersected inside one task.
MOST_SETS = 1024
PRINTS = ["entry", "n", "u", "w"]


def most_bits(similarity: float, bits: int = 128) -> int:
    return int(math.acos(similarity) / math.pi * bits + 1e-9)


def filter_bits(similarity: float, bits: int = 128) -> int:
    """The least distance that sets with this Jaccard similarity, of any sizes, exceed with a chance of MISS at most."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    left = 1.0
    for k in range(bits + 1):
        left -= math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if left <= MISS:
            return k
    return bits


def common_keys(similarity: float, size: int = SKETCH) -> int:
    """How many keys two sketches share at least, but for a chance of MISS: each of the size smallest hashes of both sets is in both by that chance."""
    left = 0.0
    for k in range(size + 1):
        left += math.comb(size, k) * similarity**k * (1 - similarity) ** (size - k)
        if left > MISS:
            return max(1, k)
    return size


def _second(h: np.ndarray) -> np.ndarray:
    """Other bits of the same hashes."""
    x = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of all distinct shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, digest, join = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest, b" ".join
    found = []
    for at in range(0, n, 65536):
        part = words[at : min(n, at + 65536) + shingle - 1]
        parts = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        found.append(np.unique(np.array([digest(join(x), SEED) for x in parts], np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def entry_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def sketch(hashes: np.ndarray, similarity: float) -> tuple[int, int, int, list[int]]:
    """Both fingerprint words, how many keys a set is looked up by, and the smallest shingle hashes of a sorted set."""
    n = len(hashes)
    counts = np.zeros(128, np.int64)
    for at in range(0, n, 65536):
        h = hashes[at : at + 65536]
        both = np.stack([h, _second(h)], axis=1).astype(">u8")
        counts += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n).tobytes()
    shared = common_keys(similarity)
    if n <= SKETCH:
        shared = min(shared, math.ceil(similarity * n - 1e-9))
    keys = hashes[:SKETCH].tolist()
    return int.from_bytes(bits[:8], "big"), int.from_bytes(bits[8:], "big"), len(keys) - shared + 1 if n else 0, keys


def sketches(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, entry, n, u, w, held, keys): entry is the print of the whole set, n its size, held how many of its keys it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in as_bytes(b, text):
                h = shingles(x, shingle)
                found.append((entry_of(h), len(h), *sketch(h, similarity)))
            numbers = (column(np.array([f[k] for f in found], np.uint64).view(np.int64), pa.int64()) for k in range(5))
            keys = pa.array([np.array(f[5], np.uint64).view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *numbers, keys], names=["doc_id", *PRINTS, "held", "keys"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, entry long, n long, u long, w long, held long, keys array<long>")


def sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(root, blocks, entry, hashes) of the rows whose text is the entry's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x, shingle) for x in as_bytes(b, text)]
            entry = np.array([entry_of(h) for h in found], np.uint64).view(np.int64)
            hashes = pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays([b.column("root"), b.column("blocks"), b.column("entry"), hashes], names=["root", "blocks", "entry", "hashes"])
            yield out.filter(column(entry == b.column("entry").to_numpy(), pa.bool_()))

    return docs.select("root", "blocks", "entry", text).mapInArrow(run, "root long, blocks long, entry long, hashes array<long>")


def linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs of rows (two words each) are near: the chains of the ring first, then the whole."""
    x = a ^ b
    parts = [np.bitwise_count((x[:, k // 4] >> np.uint64(16 * (k % 4))) & np.uint64(0xFFFF)).astype(np.int16) for k in range(SEGMENTS)]
    left = np.arange(len(x))
    chained = np.zeros(len(x), bool)
    for start in range(SEGMENTS):
        at, sums = left[~chained[left]], None
        for length in range(1, SEGMENTS):
            if not len(at):
                break
            add = parts[(start + length - 1) % SEGMENTS][at]
            sums = add if sums is None else sums + add
            good = sums <= length * distance // SEGMENTS
            at, sums = at[good], sums[good]
        chained[at] = True
    at = np.flatnonzero(chained)
    chained[at] = np.bitwise_count(x[at]).sum(1) <= distance
    return chained


def _forest(keys: np.ndarray | None, prints: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the candidates inside runs of equal keys; without keys all rows are one run."""
    forest, n, bits, distance = Forest(prints[:, 0]), prints[:, 1], np.ascontiguousarray(prints[:, 2:]).view(np.uint64), filter_bits(similarity)
    d, left = 1, np.arange(len(prints))
    while len(left := left[left + d < len(prints)]) and (keys is None or len(left := left[keys[left] == keys[left + d]])):
        x, y = n[left], n[left + d]
        good = left[np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6]
        good = good[linked(bits[good], bits[good + d], distance)]
        forest.link(good, good + d)
        d += 1
    return forest.edges()


def link_sorted(similarity: float):
    """Over a partition sorted by key (key, entry, n, u, w): edges (u, v) inside runs of equal keys. Holds a batch and a run at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column(x, pa.int64()) for x in _forest(keys, prints, similarity)], schema=EDGES)

        keys, prints = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            prints = np.concatenate((prints, np.stack([b.column(k).to_numpy() for k in range(1, 5)], axis=1)))
            if len(keys):
                whole = int(_runs(keys)[0][-1])  # the last run may go on
                yield edges(keys[:whole], prints[:whole])
                keys, prints = keys[whole:], prints[whole:]
        if len(keys):
            yield edges(keys, prints)

    return run


def _link_blocks(similarity: float):
    def run(pdf):
        u, v = _forest(None, np.ascontiguousarray(pdf[PRINTS].to_numpy(np.int64)), similarity)
        return pdf.iloc[:0].reindex(columns=["u", "v"]).assign(u=u, v=v)

    return run


def similar_sets(entries: np.ndarray, held: list[np.ndarray], similarity: float, measure: str = "jaccard") -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all pairs of sets with the similarity or more, from their exact intersections."""
    entries, first = np.unique(entries, return_index=True)
    held = [held[k] for k in first]
    n = np.array([len(h) for h in held], np.int64)
    end = np.cumsum(n)
    slot = np.unique(np.concatenate(held), return_inverse=True)[1]
    at = np.argsort(slot, kind="stable")
    of, begin = np.repeat(np.arange(len(n)), n)[at], np.r_[0, np.cumsum(np.bincount(slot))]
    forest = Forest(entries)
    for i in range(len(n) - 1):
        if (forest.label == forest.label[0]).all():
            break
        own = slot[end[i] - n[i] : end[i]]
        many = begin[own + 1] - begin[own]
        take = np.repeat(begin[own] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        common = np.bincount(of[take], minlength=len(n))
        whole = n[i] + n - common if measure == "jaccard" else np.sqrt(float(n[i]) * n)
        good = np.flatnonzero(common >= similarity * whole - 1e-6)
        good = good[good > i]
        forest.link(np.full(len(good), i), good)
    return forest.edges()


def verify_sorted(similarity: float, measure: str = "jaccard"):
    """Over a partition sorted by component and pair of blocks (root, i, j, entry, hashes): edges (u, v)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, held = None, [], []

        def edges() -> Iterator[pa.RecordBatch]:
            if len(entries) > 1:
                u, v = similar_sets(np.array(entries, np.int64), held, similarity, measure)
                yield pa.RecordBatch.from_arrays([column(u, pa.int64()), column(v, pa.int64())], schema=schema)

        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(3)))
            hashes = b.column(4)
            for k, (key, entry) in enumerate(zip(keys, b.column(3).to_pylist())):
                if key != now:
                    yield from edges()
                    now, entries, held = key, [], []
                entries.append(entry)
                held.append(hashes[k].values.to_numpy())
        yield from edges()

    return run


def lookup_keys(entries: DataFrame, staged: Staged, block: int) -> DataFrame:
    """(key, entry, n, u, w): the keys that every entry is looked up by, those that few entries have first."""
    every = entries.select("entry", F.explode("keys").alias("key"))
    hot = staged.put(every.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("key"), "hot", tidy=False)
    if not hot.isEmpty():
        met = every.join(hot, "key", "left_semi").groupBy("entry").agg(F.collect_list("key").alias("late")).withColumnRenamed("entry", "__e")
        entries = entries.join(met, entries.entry == met["__e"], "left")
        late = F.coalesce("late", F.array().cast("array<long>"))
        entries = entries.withColumn("keys", F.concat(F.array_except("keys", late), F.array_sort(late)))
    return entries.select(F.explode(F.slice("keys", F.lit(1), F.col("held").cast("int"))).alias("key"), *PRINTS)


def candidates(entries: DataFrame, staged: Staged, similarity: float, block: int) -> DataFrame:
    """Edges (u, v) of entries that connect all candidates."""
    keyed = staged.put(lookup_keys(entries, staged, block), "keyed")
    over = staged.put(keyed.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > block), "over", tidy=False)
    some = not over.isEmpty()
    rest = keyed.join(over, "key", "left_anti") if some else keyed
    edges = rest.select("key", *PRINTS).repartition("key").sortWithinPartitions("key", "entry").mapInArrow(link_sorted(similarity), "u long, v long")
    if some:
        blocks = F.ceil(F.col("many") / F.lit(block))
        mine, other = F.pmod(F.xxhash64("entry"), blocks).alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
        pairs = keyed.join(over, "key").select("key", *PRINTS, mine, other)
        pairs = pairs.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *PRINTS)
        edges = edges.union(pairs.groupBy("key", "i", "j").applyInPandas(_link_blocks(similarity), "u long, v long"))
    return edges


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = BLOCK, most_sets: int = MOST_SETS, measure: str = "jaccard") -> DataFrame:
    """A row per input row: doc_id and component_id, the smallest id that links reach; measure is jaccard or cosine."""
    if measure not in ("jaccard", "cosine"):
        raise ValueError(f"no measure {measure}")
    least = similarity if measure == "jaccard" else similarity * similarity
    staged = Staged(docs.sparkSession, "similar")
    found = staged.put(sketches(docs, doc_id, text, shingle, least), "sketches")
    # The keys follow from the set, so any row's will do; a number that tells two sets apart keeps them apart.
    entries = found.groupBy(*PRINTS).agg(F.min("held").alias("held"), F.min("keys").alias("keys"), F.min("doc_id").alias("low"))
    near = components(candidates(entries, staged, least, block), staged, name="near")
    near = near.union(near.select(F.col("root").alias("node"), "root").distinct())
    blocks = F.ceil(F.count("*") / F.lit(most_sets)).alias("blocks")
    members = near.join(near.groupBy("root").agg(blocks), "root").join(entries.select("entry", "low"), F.col("node") == F.col("entry"))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(members, same(F.col("__id"), F.col("low")))
    held = sets(texts, "__text", shingle)
    mine = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("entry"), F.col("blocks"))).otherwise(F.lit(0).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = held.select("root", mine.alias("mine"), other, "entry", "hashes").select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "entry", "hashes")
    pairs = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    roots = components(pairs.mapInArrow(verify_sorted(similarity, measure), "u long, v long"), staged)
    rooted = entries.join(roots, entries.entry == roots.node, "left").select("entry", "low", F.coalesce("root", "entry").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("entry", "component_id")
    return found.select("doc_id", "entry").join(named, "entry").select(F.col("doc_id").alias(doc_id), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, measure: str = "jaccard") -> DataFrame:
    """One row of each group, with all its columns: that of the smallest id; rows that repeat an id are one document, see one_row_each."""
    found = groups(docs, doc_id, text, shingle, similarity, measure=measure)
    # n counts all rows of an id, also those of other groups
    first = found.groupBy(doc_id).agg(F.count("*").alias("n"), F.bool_or(same(F.col(doc_id), F.col("component_id"))).alias("first")).filter("first")
    return one_row_each(docs, first, doc_id)
