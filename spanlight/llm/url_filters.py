"""URL filters over a sorted digest array.

Rules are host and path prefix, like `example.com/en/`. Each is stored as the 64-bit xxhash of
its string in a sorted array, next to its verdict and the string itself. Tasks write the array
in parts by the digests' first bits, Spark hands them to every executor once, and workers map
them into memory, so they share the pages and none holds the list on its heap. The hosts of
the rules are keys of the same array, with the lengths that their rules' paths have. Of a url,
its host and all parent domains are looked up first; those that have rules give the candidate
keys: the domain with the prefixes of the url's path of such a length. Keys are probed by a
vectorised binary search, and a hit counts only if the stored string is the key. The longest
rule that fits wins.

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z
lower-cased; the path follows up to `?`, `#` or the end. A null url, or one without `://`, has
both empty. A url that no rule fits gets the default verdict, as it is on no list. Rules that
repeat are one rule; of two verdicts for one rule, block stands; null rules are none. Every row
is judged by itself, null and repeated ids too. An empty table or rule list works like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mapped import handed, hand_out, opened, pack

#: Bytes of one part of the array, about.
MAX_BYTES = 64 << 20
ALLOW, BLOCK = "allow", "block"
#: Path lengths are bits of one number; the last bit stands for this length and all above.
LAST_BIT = 62
#: What marks a host among the keys; no rule starts with it.
HOST_MARK = "\x00"


def digest(rule: bytes) -> int:
    """Equals the JVM's xxhash64 of the string."""
    return xxhash.xxh64_intdigest(rule, 42)


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host, path = (rest[:end], "") if slash < 0 else (rest[:slash], rest[slash:end])
    return host.translate(LOWER), path


#: A-Z to a-z; other letters stay.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class DigestArray:
    """A mapped part: sorted digests, string ends, values, strings."""

    def __init__(self, path: str):
        x = opened(path)
        self.digests, self.ends, self.values, self.strings = x["digests"], x["ends"], x["values"], x["strings"]

    def text(self, i: int) -> bytes:
        return self.strings[self.ends[i] : self.ends[i + 1]].tobytes()

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The key's place in the array, or -1; equal digests are told apart by the stored strings."""
        return self.probe_digests(keys, np.fromiter(map(digest, keys), np.uint64, len(keys)))

    def probe_digests(self, keys: list[bytes], wanted: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not len(wanted):
            return found
        low = np.searchsorted(self.digests, wanted, "left")
        for k in np.flatnonzero(self.digests[np.minimum(low, len(self.digests) - 1)] == wanted):
            i = int(low[k])
            while i < len(self.digests) and self.digests[i] == wanted[k]:
                if self.text(i) == keys[k]:
                    found[k] = i
                    break
                i += 1
        return found


def packed(entries: list[tuple[bytes, int]]) -> bytes:
    """entries: keys with their values, sorted by digest."""
    texts = [t for t, _ in entries]
    return pack(
        {
            "digests": np.array([digest(t) for t in texts], np.uint64),
            "ends": np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64),
            "values": np.array([int(v) for _, v in entries], np.int64),
            "strings": np.frombuffer(b"".join(texts), np.uint8),
        }
    )


def write_array(path: str, entries: list[tuple[bytes, int]]) -> None:
    with open(path, "wb") as out:
        out.write(packed(entries))


def rule_table(spark: SparkSession, rules: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """(host, path, block): every rule once, from a table (verdict, rule) or a list of such pairs."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, rule string")
    upper, lower = ("".join(map(chr, x)) for x in (LOWER.keys(), LOWER.values()))
    before = F.substring_index("rule", "/", 1)
    r = rules.filter("rule is not null").select(F.translate(before, upper, lower).alias("host"), F.substring(F.col("rule"), F.length(before) + 1, F.length("rule")).alias("path"), (F.col("verdict") == BLOCK).alias("block"))
    return r.groupBy("host", "path").agg(F.coalesce(F.max("block"), F.lit(False)).alias("block"))


class RuleArrays:
    """The parts of the array, known to every executor by their files' names."""

    def __init__(self, spark: SparkSession, rules: DataFrame | list[tuple[str, str]], max_bytes: int = MAX_BYTES):
        r = rule_table(spark, rules)
        bit = F.least(F.length("path"), F.lit(LAST_BIT))
        hosts = r.groupBy("host").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("value"))
        entries = r.select(F.concat("host", "path").alias("key"), F.col("block").cast("long").alias("value"))
        entries = entries.unionByName(hosts.select(F.concat(F.lit(HOST_MARK), "host").alias("key"), "value"))
        size, long = r.agg(F.sum(F.octet_length("host") * 2 + F.octet_length("path") + 48), F.collect_set(F.when(F.length("path") >= LAST_BIT, F.length("path")))).first()
        #: The path lengths from LAST_BIT on that some rule has.
        self.long = sorted(long)
        self.bits = max(0, (max(1, -(-(size or 0) // max_bytes)) - 1).bit_length())
        part = F.call_function("shiftrightunsigned", F.xxhash64("key"), F.lit(64 - self.bits)).cast("int") if self.bits else F.lit(0)

        def build(t: pa.Table) -> pa.Table:
            rows = [(k.encode(), v) for k, v in zip(t.column("key").to_pylist(), t.column("value").to_pylist())]
            rows.sort(key=lambda x: (digest(x[0]), x[0]))
            return pa.table({"part": t.column("part").slice(0, 1), "payload": pa.array([packed(rows)], pa.binary())})

        parts = entries.withColumn("part", part).groupBy("part").applyInArrow(build, "part int, payload binary")
        self.names = hand_out(parts, "url_rules")


class Rules:
    """In a task: the mapped parts, probed by the part that a key's digest names."""

    def __init__(self, names: list[str], bits: int, long: list[int]):
        self.arrays = {p: DigestArray(f) for p, f in handed(names).items()}
        self.bits, self.long = bits, long

    def values(self, keys: list[bytes]) -> list[int | None]:
        """The value stored with each key, or None."""
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        of = (wanted >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        out: list[int | None] = [None] * len(keys)
        for p in np.unique(of):
            if (a := self.arrays.get(int(p))) is not None:
                own = np.flatnonzero(of == p)
                at = a.probe_digests([keys[k] for k in own], wanted[own])
                for k, i in zip(own[at >= 0], at[at >= 0]):
                    out[k] = int(a.values[i])
        return out

    def lengths(self, mask: int) -> list[int]:
        return [n for n in range(LAST_BIT) if mask >> n & 1] + (self.long if mask >> LAST_BIT & 1 else [])

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str, bool] | None]:
        """For each (host, path) the longest rule that fits and whether it blocks."""
        known: dict[str, list[tuple[str, int]]] = {h: [] for h, _ in parts}
        asked = [(h, ".".join(x[k:])) for h in known for x in [h.split(".")] for k in range(len(x))]
        for (h, domain), mask in zip(asked, self.values([(HOST_MARK + d).encode() for _, d in asked])):
            if mask is not None:
                known[h].append((domain, mask))
        keys = [candidates(path, [(d, self.lengths(m)) for d, m in known[host]]) for host, path in parts]
        flat = [k for x in keys for k in x]
        found, at, out = self.values(flat), 0, []
        for x in keys:
            own = next((j for j in range(at, at + len(x)) if found[j] is not None), None)
            out.append(None if own is None else (flat[own].decode(), found[own] > 0))
            at += len(x)
        return out


def candidates(path: str, domains: list[tuple[str, list[int]]]) -> list[bytes]:
    """All rules that would fit, the longest first."""
    return sorted({(d + path[:n]).encode() for d, lengths in domains for n in lengths if n <= len(path)}, key=lambda x: (-len(x), x))


def judge_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], page_id: str = "page_id", url: str = "url", default: str = ALLOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row per input row: page_id, host, path, the rule that decides (or null) and the verdict.

    rules: a table (verdict, rule) or a list of such pairs; verdict is allow or block, rule is
    host and path prefix. A rule without `/` fits any path.
    """
    held = RuleArrays(pages.sparkSession, rules, max_bytes)
    names, bits, long = held.names, held.bits, held.long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rules(names, bits, long)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = own.judge(parts)
            verdict = [default if x is None else BLOCK if x[1] else ALLOW for x in found]
            columns = [[h for h, _ in parts], [p for _, p in parts], [x and x[0] for x in found], verdict]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[page_id, "host", "path", "rule", "verdict"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(page_id, url).mapInArrow(run, f"`{page_id}` {kind}, host string, path string, rule string, verdict string")
