import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanlight.llm import queries
from spanlight.llm.private_data import PrivacyOptions, entities, personal_spans, sanitise

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, *m.span(), m[0]) for k, form in FORMS.items() for m in re.finditer(form, text or "") if passes(k, m[0])]


def normal(kind, s):
    return s.lower() if kind == "email" else ".".join(str(int(p)) for p in s.split(".")) if kind == "ip" else re.sub("[^0-9]", "", s)


def free_terms(text, spans):
    found = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", text) if len(m[0]) >= 3]
    return [t for t in found if not any(a < t[2] and t[1] < b for _, a, b, _ in spans)]


def plain(rows, o=PrivacyOptions()):
    """Every document against every other by sets."""
    n_term, both, texts, own = Counter(), Counter(), defaultdict(set), []
    for _, text in rows:
        text = text or ""
        n_term.update({t.lower() for t in re.findall(r"[^\W_]+", text) if len(t) >= o.shortest})
        spans = base(text)
        pairs = set()
        for kind, a, _, s in spans:
            free = free_terms(text, spans)
            before = [t for t in free if t[1] < a]
            after = [t for t in free if t[1] >= a]
            pairs |= {((kind, normal(kind, s)), t[0]) for t in before[max(0, len(before) - o.reach) :] + after[: o.reach]}
        for p in pairs:
            both[p] += 1
            texts[p].add(text)
        own.append(pairs)
    bits = {p: math.log2(n_term[p[1]] / n) for p, n in both.items() if len(texts[p]) >= o.least_texts}
    out = []
    for (doc_id, text), pairs in zip(rows, own):
        text = text or ""
        spans = base(text)
        least = {}
        for p in pairs:
            if p in bits:
                least[p[1]] = min(least.get(p[1], 99), bits[p])
        more = [("removed" if least[t] <= o.remove_bits else "generalised", a, b) for t, a, b in free_terms(text, spans) if least.get(t, 99) <= o.generalise_bits]
        n = Counter(s[0] for s in spans)
        tell = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        first = tell(s[:3] for s in spans)
        last = tell(sorted(more, key=lambda s: (s[0] == "generalised", s[1])))
        out.append((doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(first.encode()).hexdigest(), ",".join(filter(None, [first, last]))))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=str)


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert rows_of(queries.op11_pii(spark, path)) == plain(docs)


def planted():
    """Invented people whose names and towns stand beside their addresses in several texts, common words around them, and copies."""
    rng = random.Random(7)
    common = ["account", "please", "write", "soon", "office", "about", "the", "letter", "Friday", "2019"]
    people = [(f"Name{k}", f"Town{k % 4}", rng.choice([f"user{k}@mail.example.com", f"+1 (234) 555-{1000 + k}", f"10.0.0.{k}", "4111 1111 1111 1111"])) for k in range(12)]
    rows = []
    for k in range(160):
        name, town, address = people[k % 12]
        words = rng.choices(common, k=40)
        if k % 3:
            words[rng.randint(15, 25) : 20] = [name, address, town]
        rows.append((k, " ".join(words)))
    rows += [rows[1]] * 30 + [(1000, rows[2][1]), (1001, "Name1 and Town1 alone"), (None, None), (3, "")]
    return rows


def test_names_beside_addresses_go_and_common_words_stay(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for o in (PrivacyOptions(), PrivacyOptions(reach=2, least_texts=1, remove_bits=0.0, generalise_bits=3.0, held=20)):
        assert rows_of(personal_spans(df, o)) == plain(rows, o)
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert "removed" in str(plain(rows)) and "generalised" in str(plain(rows))
    assert "Name4" not in clean[4] and "@" not in clean[4] and "account" in clean[4]
    assert clean[1001] == "Name1 and Town1 alone" and clean[3] is not None


def test_forms_equal_plain_patterns(spark):
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", ".", "-", "_", "%", "+", "1", "25", "256", "0", " ", "(", ")", "@x.y", "4111111111111111", "+1 23", "1.2.3.4", "é", "\n", "4111-1111 1111-1111 "]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert [e[:3] for e in entities(text)] == [e[:3] for e in base(text)], text


def test_long_runs_take_linear_time():
    for piece in ("a", "1", "1.", "1 ", "a@", "a@b.c", "+1", "+1 ", "1.1.1.1", "a.", "@"):
        began = time.time()
        entities(piece * 200_000)
        assert time.time() - began < 5, piece
    assert [e[0] for e in entities("x" * 500_000 + " u@v.w " + "9" * 500_000)] == ["email"]


def test_edges(spark):
    schema = "doc_id string, text string, text_key string, hidden int, spans int, pairs string"
    empty = spark.createDataFrame([], schema)
    assert personal_spans(empty).collect() == [] and sanitise(empty).collect() == []
    rows = [(None, None), ("a", ""), ("b", "x@y.zz"), ("b", "x@y.zz"), ("b", "no"), ("c", "word " * 100_000 + "+1 (234) 555-1234")]
    df = spark.createDataFrame([(*r, "k", 1, 2, "p") for r in rows], schema)
    assert rows_of(personal_spans(df)) == plain(rows)
    got = sanitise(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or "", (r.text or "")[-12:]) for r in got.collect()) == [("", ""), ("a", ""), ("b", "[EMAIL]"), ("b", "[EMAIL]"), ("b", "no"), ("c", "word [PHONE]")]
    assert got.filter(F.col("doc_id").isNull()).first().text is None
