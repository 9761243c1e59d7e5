import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlight.llm import quality_classifier, queries, toxicity

PATH = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held_out_quality(spark, query, label, fold, rest):
    rows = query(spark, PATH).collect()
    assert len(rows) == spark.read.parquet(f"{PATH}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    test = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    y, s, p = (np.array(x) for x in zip(*test))
    ranks = np.argsort(np.argsort(s))
    n = (y == 1).sum()
    return (ranks[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n)), (p == y).mean()


def test_quality_on_held_out_rows(spark):
    auc, accuracy = held_out_quality(spark, queries.op5_quality_classifier, "quality", 3, 1)
    assert auc > 0.99 and accuracy > 0.98


def test_toxicity_on_held_out_rows(spark):
    auc, accuracy = held_out_quality(spark, queries.op7_toxicity, "toxic", 5, 0)
    assert auc > 0.97 and accuracy > 0.96


def test_prior_estimate():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        good, bad = rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000)
        mixed = np.where(rng.random(6000) < prior, rng.normal(2, 1, 6000), bad)
        assert quality_classifier.estimate_prior(good, mixed) == pytest.approx(prior, abs=0.06)


@pytest.mark.parametrize("module, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_edges(spark, module, label):
    rows = [(None, None, "x", "s", 1), (1, "", None, None, None), (2, "word " * 30000, "x", "s", 1), (2, "word " * 30000, "x", "s", 1), (3, "x" * 200000, "x", "s", 1), (4, "a\0b é ñ 😀", "x", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 1), (4, 1)], f"doc_id long, {label} int")
    for own in (labels, labels.filter(F.col(label) == 1), labels.filter("doc_id > 9")):
        model = module.train(docs, own)
        found = module.score(docs, model).collect()
        assert sorted(r.doc_id or 0 for r in found) == [0, 1, 2, 2, 3, 4]
        assert all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id == 2}) == 1
    nothing = docs.limit(0)
    assert module.score(nothing, module.train(nothing, labels)).collect() == []


def test_scorer_equals_bucket_lists():
    options = toxicity.ToxicityOptions(cache=5)
    rng = np.random.default_rng(3)
    weights = np.where(rng.random(options.buckets) < 0.01, rng.normal(size=options.buckets), 0).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abcéñ"), rng.integers(1, 90))) for _ in range(rng.integers(0, 40))).encode() for _ in range(60)]
    model = toxicity.Model(weights, 0.25)
    want = [0.25 + weights[x].sum(dtype=np.float64) for x in toxicity.Grams(options).texts(texts)]
    scorer = toxicity.Scorer(model, options)
    got = np.concatenate([scorer.scores(texts[:30]), scorer.scores(texts[30:])])
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(want))))


@pytest.mark.parametrize("n", [1, 3, 10, 20, 60])
def test_few_rows_are_learned_from(n):
    """Separable texts: the model separates from a row of each class on, and the more the clearer."""
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    text = lambda bad: " ".join(["zzqwx"] * bad + [word() for _ in range(8)]).encode()
    options, y = toxicity.ToxicityOptions(), np.array([1] * n + [0] * n)
    model = toxicity.fit(toxicity.Grams(options).texts([text(v) for v in y]), y, options)
    s = toxicity.Scorer(model, options).scores([text(True) for _ in range(40)] + [text(False) for _ in range(40)])
    assert s[:40].mean() > s[40:].mean() and (n < 10 or s[:40].min() > 0.5 > s[40:].max())


def test_queries_equal_scores_by_hand(spark):
    """The queries' scores are those of the fitted model on each whole text, computed apart from Spark."""
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    fold = lambda n: F.crc32(F.col("doc_id").cast("string")) % n
    model = toxicity.train(docs, labels.select("doc_id", "toxic").filter(fold(5) != 0))
    options, got = toxicity.ToxicityOptions(), {r.doc_id: r.score for r in queries.op7_toxicity(spark, path).collect()}
    for d, t in texts.items():
        grams = {g for w in t.decode().lower().split() for k in range(3, 7) for g in [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]}
        z = model.intercept + sum(model.weights[b] for b in {bucket(g, options.buckets) for g in grams})
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def bucket(gram: str, buckets: int) -> int:
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
    h = h * 0x9E3779B97F4A7C15 % 2**64
    return (h ^ (h >> 32)) % buckets


def test_quality_scores_equal_a_sum_by_hand(spark):
    """Every text's measures against the model's edges, one by one, without numpy."""
    import math

    import zstandard

    from spanlight.llm import quality_classifier as QC

    rows = [(k, ("good words, and more of them. " if k % 3 else "x1 !! ") * (k % 7 + 1)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(60) if k % 3 == 1], "doc_id long, quality int")
    model = QC.train(docs, labels)
    press = zstandard.ZstdCompressor(level=1)
    for r in QC.score(docs, model).collect():
        x, z, at = QC.measures(dict(rows)[r.doc_id].encode(), press), model.intercept, 0
        for k, edges in enumerate(model.edges):
            for e in edges:
                z += float(model.weights[at]) if x[k] > e else 0.0
                at += 1
        assert at == len(model.weights) and abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5)


@pytest.mark.parametrize("module, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_an_id_that_repeats_is_one_training_row(spark, module, label):
    docs = [(1, f"bad thing number {k}") for k in range(50)] + [(2, "nice day here"), (3, "another fine text")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], f"doc_id long, {label} int")
    once = [(1, min((t for i, t in docs if i == 1), key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())), *docs[50:]]
    a, b = (module.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (docs, once))
    assert a.intercept == b.intercept and (a.weights == b.weights).all()
