import base64
import random
from collections import Counter

from pyspark.sql import functions as F

from spanlight.llm import queries
from spanlight.llm.quality_rules import keep_quality, measure_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SEP = " \t\n\x0b\x0c\r"


def plain(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_measures_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = queries.op9_quality_rules(spark, "/root/testdata/sf0.001").collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found}
    assert got == {r.doc_id: plain(r.text) for r in docs}
    assert not any(r.kept and r.base_failed for r in found)


def test_clean_stay_and_junk_goes(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    found = queries.op9_quality_rules(spark, path).filter("not base_failed").join(labels, "doc_id")
    share = {r.quality: r.kept for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] == 1.0


def test_edges(spark):
    assert measure_quality(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(1)
    noise = base64.b64encode(rng.randbytes(30000)).decode()
    rows = [
        (None, None, None, None, None),
        (1, "", "en", "s", 0),
        (2, "a b c\x0bd\x1ce", "en", "s", 0),
        (3, " ".join(noise[i : i + 9] for i in range(0, len(noise), 9)), "en", "s", 0),
        (4, "\n".join(f"line number {i} says the same thing again and again to us" for i in range(400)), "en", "s", 0),
        (4, "\n".join(f"line number {i} says the same thing again and again to us" for i in range(400)), "en", "s", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine")).withColumn("ratio", F.lit(1))
    found = measure_quality(df).collect()
    assert len(found) == 6
    assert [r.kept for r in found] == [False] * 6
    assert {r.doc_id: (r.n_words, r.word_chars) for r in found if r.doc_id in (1, 2)} == {1: (0, 0), 2: (3, 7)}
    kept = keep_quality(df)
    assert kept.columns == df.columns and kept.collect() == []


def test_every_part_of_a_text_is_judged(spark):
    """Junk behind good prose, in the last part of a chunk or in one chunk of many, and short random text go; the prose stays."""
    path, rng = "/root/testdata/sf0.1", random.Random(5)
    labels = spark.read.parquet(f"{path}/labels.parquet").filter("quality = 1")
    prose = max((r.text for r in spark.read.parquet(f"{path}/documents.parquet").join(labels, "doc_id").collect()), key=len)
    noise = lambda n: " ".join(x[i : i + 5] for x in [base64.b64encode(rng.randbytes(n)).decode()] for i in range(0, n, 5))[:n]
    good = [prose[:16384], prose[:4096], prose[:5000], prose[:2000], prose[:600]]
    junk = [prose[:4096] + " buy it here now" * 130, prose[:4096] + noise(4000), prose[:8192] + noise(4096) + prose[8192:16384], prose[:4096] + noise(600), noise(500), noise(1000), noise(2000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(good + junk)], "doc_id long, text string")
    found = sorted((r.doc_id, r.base_failed, r.kept) for r in measure_quality(df).collect())
    assert found == [(k, False, k < len(good)) for k in range(len(good + junk))]


def plain_kept(text):
    """The verdict from the docstring's words, chunk by chunk, with one compressor a call."""
    import zstandard

    from spanlight.llm.quality_rules import BANDS

    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))
    inside = lambda x: next(low <= ratio(x) <= high for most, low, high in BANDS if most is None or len(x) <= most)
    raw = (text or "").encode()
    if plain(text)[-1] or not inside(raw):
        return False
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    if len(chunks) == 1:
        return True
    full = [ratio(c) for c in chunks if len(c) == 4096]
    tail = raw[-max(len(raw) % 4096, 1024) :] if len(raw) % 4096 else None
    few = sum(not 1.70 <= x <= 3.5 for x in full) <= len(full) / 5
    return few and all(1.55 <= x <= 5.0 for x in full) and (tail is None or inside(tail))


def test_kept_equals_a_plain_version(spark):
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    found = {r.doc_id: r.kept for r in queries.op9_quality_rules(spark, path).collect()}
    assert found == {k: plain_kept(t) for k, t in docs.items()} and 100 < sum(found.values()) < len(found)
