import random

from pyspark.sql import functions as F

from spanlight.llm import queries
from spanlight.llm.decontaminate import MIN_ITEM, MIN_MATCHED, MIN_SHARE, LONG_MATCHED, best_run, contaminated, tokens, without_contaminated

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(docs, items):
    """Every item on every diagonal of every text, without seeds."""
    found = set()
    for d, text in docs:
        words = tokens((text or "").encode())
        for i, item in items:
            own = tokens((item or "").encode())
            if len(own) < MIN_ITEM:
                continue
            best = 0
            for shift in range(-len(own) + 1, len(words)):
                first, last = max(0, -shift), min(len(own), len(words) - shift)
                same = np.array([own[k] == words[k + shift] for k in range(first, last)])
                if same.sum() > best:
                    best = max(best, best_run(same)[2])
            if best >= LONG_MATCHED or best >= min(MIN_MATCHED, len(own)) and best >= MIN_SHARE * len(own):
                found.add((d, i))
    return found


def test_planted_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("bcdfg") + str(rng.randrange(500))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 9, 14, 30, 60])))) for i in range(25)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(80))]
        if d % 2:
            own = rng.choice(items)[1].split()
            own = [word() if rng.random() < (d % 5) * 0.04 else w.upper() + rng.choice(["", ",", "."]) for w in own]
            text[len(text) // 2 : len(text) // 2] = own[rng.randrange(3) :]
        docs.append((d, " ".join(text)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(a, b).collect()}
    assert got == plain(docs, items) and len(got) > 10
    assert {(r.doc_id, r.item_id) for r in contaminated(a, b, block_tokens=40).collect()} == got
    assert {r.doc_id for r in without_contaminated(a, b, block_tokens=100).collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_whole_items_of_the_table_are_found(spark):
    path = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{path}/documents.parquet").collect(), spark.read.parquet(f"{path}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, path).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if i.text and i.text in (d.text or "")}
    assert exact and exact <= got


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1)], SCHEMA)
    docs = docs.withColumn("item_id", F.lit(1)).withColumn("n_item", F.lit("x"))
    items = spark.createDataFrame([(7, None), (8, ""), (9, "A, b c d E!"), (9, "A, b c d E!")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_matched) for r in contaminated(docs, items).collect()) == [(2, 9, 5)] * 4
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, nothing).collect() == [] and without_contaminated(docs, nothing).count() == 4
    assert contaminated(docs.limit(0), items).collect() == []


def test_substituted_and_short_items(spark):
    words = lambda n: [f"w{k}" for k in range(n)]
    pattern = "xxx.xxx.x..xxxx.xxxxxxx.x."
    spread = " ".join(w if x == "x" else "other" for w, x in zip(words(26), pattern))
    eleven = " ".join(f"e{k}" if k != 5 else "other" for k in range(11))
    docs = [(1, f"so {spread} so"), (2, f"so {eleven} so"), (3, "Yes, it is."), (4, "yes it is so"), (5, " ".join(words(26)[:8] + ["other"] * 18))]
    items = [(1, " ".join(words(26))), (2, " ".join(f"e{k}" for k in range(11))), (3, "yes it is")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_matched) for r in contaminated(a, b).collect()) == [(1, 1, 19), (2, 2, 10), (3, 3, 3)]


def test_recall_of_substituted_overlaps(spark):
    """Of all overlaps that meet the criterion at up to 30 % substitutions at least 0.95 are found (by simulation 0.98 at the worst size and rate); every second to sixth token replaced, all."""
    rng = random.Random(8)
    items, docs, want = [], [], {}
    for size in (12, 14, 16, 20, 30, 60):
        for k in range(120):
            own = [f"i{size}x{k}w{j}" for j in range(size)]
            rate = (0.1, 0.2, 0.3)[k % 3]
            said = [w if rng.random() >= rate else f"o{size}x{k}w{j}" for j, w in enumerate(own)]
            items.append((len(items), " ".join(own)))
            docs.append((len(docs), "so they say " + " ".join(said) + " and so on"))
            n = sum(a == b for a, b in zip(own, said))
            if n >= min(10, size) and n >= 0.5 * size:
                want.setdefault(size, []).append(len(docs) - 1)
    for every in (2, 3, 4, 5, 6):
        own = [f"p{every}w{j}" for j in range(60)]
        items.append((len(items), " ".join(own)))
        docs.append((len(docs), " ".join(w if j % every else "other" for j, w in enumerate(own))))
        want.setdefault(f"every {every}", []).append(len(docs) - 1)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id for r in contaminated(a, b).collect()}
    recall = {size: len(got & set(ids)) / len(ids) for size, ids in want.items()}
    assert min(recall.values()) >= 0.95, recall
    assert got <= {d for ids in want.values() for d in ids}


def test_many_items_that_start_alike():
    """A stem of ten tokens that 3000 items share, in 40 texts that say it twice: compared as arrays, and only real overlaps count."""
    import time

    import pyarrow as pa

    from spanlight.llm.decontaminate import MASKS, Hashes, Part, packed
    import tempfile

    stem = "which of the following is true about the famous city"
    texts = [f"{stem} " + " ".join(f"a{i}b{j}" for j in range(20)) for i in range(3000)]
    with tempfile.NamedTemporaryFile() as f:
        f.write(packed(pa.array(range(3000)), [t.encode() for t in texts], np.ones(3000, np.int64), MASKS))
        f.flush()
        part, known = Part(f.name), Hashes()
        began = time.time()
        for i in range(40):
            said = f"{stem} {stem} {texts[7 * i]} and more"
            assert [x[0] for x in part.overlaps(known.of(tokens(said.encode())))] == [7 * i]
        assert time.time() - began < 6


def test_long_texts_and_ties(spark):
    item = " ".join(f"w{k}" for k in range(20))
    text = "x " * 200_000 + item + " y" * 50_000 + f" {item}"
    a, b = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    got = sorted((r.item_id, r.n_matched, r.start_token, r.end_token) for r in contaminated(a, b).collect())
    assert got == [(1, 20, 200_000, 200_020), (2, 20, 200_000, 200_020)]
