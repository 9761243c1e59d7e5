import random
import re
import zlib
from collections import Counter

from spanlight.llm import queries
from spanlight.llm.common import Staged
from spanlight.llm.spelling import SpellingOptions, group_spellings, near_pairs, roots

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one insertion, deletion or replacement makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, every, shortest=5, least=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def plain(rows, every, shortest=5, least=3, ratio=2):
    n = counted(rows, every, shortest, least)
    form, n_near, holes, close_to = {}, {}, {}, {w: set() for w in n}
    for w in n:
        for i in range(len(w)) if len(w) < 5000 else ():
            holes.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in n:
                close_to[w].add(w[:i] + w[i + 1 :])
                close_to[w[:i] + w[i + 1 :]].add(w)
    for same in holes.values():  # alike but for one place
        for w in same:
            close_to[w].update(o for o in same if o != w)
    very = [w for w in n if len(w) >= 5000]
    for w in very:
        close_to[w].update(o for o in very if o != w and abs(len(o) - len(w)) < 2 and near(w, o))
    for w in n:
        close = sorted(close_to[w])
        best = min(close, key=lambda o: (-n[o], o), default=None)
        n_near[w], form[w] = len(close), best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], n_near[w], n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    found = rows_of(queries.op13_spelling_variants(spark, path))
    assert len(found) == len(set(found)) and set(found) == plain(docs, 97)


def test_random_words_of_a_small_alphabet(spark):
    """Many words near each other, ties and long chains of forms."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs = [(k, " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=300)).upper()) for k in range(40)]
    for every in (0, 5):
        options = SpellingOptions(shortest=2, typo_every=every, held=50)
        assert set(rows_of(group_spellings(spark.createDataFrame(docs, "doc_id long, text string"), options))) == plain(docs, every, 2)


def test_chains_lead_to_their_root(spark):
    chain = [(f"w{k:02}", f"w{k + 1:02}") for k in range(40)] + [("side", "w00")]
    found = {r.word: r.root for r in roots(spark.createDataFrame([*chain, ("w40", None)], "word string, form string"), Staged(spark, "chains")).collect()}
    assert found == {a: "w40" for a, _ in chain}


def test_pairs_meet_once(spark):
    words = ["aaaaa", "aaaaaa", "aabaa", "abbba", "aabba", "ababa", "baaaa", "aaaab", "aaaba"]
    found = [(r.word, r.other) for r in near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if near(a, b))


def test_long_words(spark):
    """Around the length from which on keys are hashes, and far above."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé") for _ in range(size)) for size in (60, 62, 63, 64, 65, 66, 90, 3000)]
    for w in list(words):
        for _ in range(6):
            at, how = rng.randrange(len(w)), rng.randrange(3)
            words.append(w[:at] + rng.choice("abcdé") * (how > 0) + w[at + (how < 2) :])
    docs = [(0, " ".join(w for w in set(words) for _ in range(rng.choice([3, 4, 9]))))]
    assert set(rows_of(group_spellings(spark.createDataFrame(docs, "doc_id long, text string")))) == plain(docs, 0)


def test_edges(spark):
    schema = "doc_id long, text string, word string, n int, root int"
    assert group_spellings(spark.createDataFrame([], schema)).collect() == []
    long = "x" * 200_000
    longer = long[:77] + "y" + long[77:]
    docs = [(None, None), (1, ""), (5, f"{longer} " * 7), (2, "Straße STRASSE straße Straße"), (2, "Straße STRASSE straße Straße"), (None, f"{long} {long} {long}"), (3, "naïve×naïve÷ naïve×naïve÷ naïve×naïve÷ nave nave nave nave")]
    df = spark.createDataFrame([(*d, "w", 1, 2) for d in docs], schema)
    assert set(rows_of(group_spellings(df))) == plain(docs, 0)
    assert set(rows_of(group_spellings(df, SpellingOptions(typo_every=2)))) == plain(docs, 2)
