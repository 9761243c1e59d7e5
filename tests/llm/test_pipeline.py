import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from spanlight.llm.decontaminate import tokens

PATH = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def without_repeats(rows):
    """Texts by id with every word gone that a window of 20 covers which starts earlier too; emptied ones go."""
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        own, gone = words(r.text), set()
        for i in range(len(own) - 19):
            w = tuple(own[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        if kept := [w for i, w in enumerate(own) if i not in gone]:
            out[r.doc_id] = " ".join(kept)
    return out


def near(rows):
    """Pairs of ids whose sets of five-word shingles, or of all words if there are fewer, have a Jaccard of 0.8 or more."""
    of, shared, sets = defaultdict(list), Counter(), {}
    for r in rows:
        own = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}
        for x in sets[r.doc_id]:
            of[x].append(r.doc_id)
    for ids in of.values():
        shared.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    return {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    items = [tokens(r.text.encode()) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    before, kept, last = {r.doc_id: r.text for r in docs.collect()}, [], []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, PATH).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        kept.append({r.doc_id for r in rows})
        assert rows and (k == 0 or kept[k] <= kept[k - 1])
        if k < 4:
            assert docs.columns == COLUMNS
        if k < 2:
            assert all(r.text == before[r.doc_id] for r in rows)
        if k == 1:  # every group of linked documents keeps one
            group = {r.doc_id: r.doc_id for r in last}
            links = near(last)
            for _ in range(len(group)):
                lower = {b: min(group[a], group[b]) for a, b in [*links, *((b, a) for a, b in links)] if group[a] < group[b]}
                if not lower:
                    break
                group |= lower
            assert links and Counter(group[d] for d in kept[1]) == Counter(set(group.values()))
        if k == 2:
            assert {r.doc_id: " ".join(words(r.text)) for r in rows} == without_repeats(last)
            assert all(len(r.text) == r.n_chars for r in rows)
        if k == 3:
            for r in rows:
                text = " " + " ".join(w.decode() for w in tokens(r.text.encode())) + " "
                assert not any(len(i) >= 10 and " " + b" ".join(i).decode() + " " in text for i in items)
        if k == 4:  # words taken come near the targets
            taken, target = Counter(), {}
            for r in rows:
                taken[r.source] += r.taken
                target[r.source] = r.target
            assert all(abs(taken[x] - target[x]) <= 0.02 * target[x] for x in target)
        last = rows
    assert len(kept[0]) < len(before) and len(kept[1]) < len(kept[0]) and len(kept[3]) < len(kept[2])
    assert {r.doc_id for r in P.run(spark, PATH).collect()} == kept[4]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, PATH).collect() == []


def test_nulls_repeats_and_clashing_names(spark):
    """Stage by stage on rows with nulls, equal rows, repeated ids and columns named like the stages' own."""
    names = ["own_key", "own_marks", "own_copies", "one_id", "one_n", "one_row", "__marks", "__copies", "__one_id", "__one_n", "marks", "kept", "component_id", "item_id", "entry", "root"]
    texts = [r.text for r in spark.read.parquet(f"{PATH}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(k // 2, t, None if k % 5 else "en", None if k % 3 else "s", 1) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, None, None, None, None), (None, texts[3], None, None, None), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{c} string" for c in names)]))
    for k, (_, stage) in enumerate(P.STAGES):
        found = stage(spark, docs, PATH)
        if k < 4:
            assert found.columns == docs.columns
            assert all(r[c] == c for r in found.collect() for c in names)
        assert found.count() > 0
    kept = P.STAGES[1][1](spark, docs, PATH)
    assert 0 < kept.count() < len(rows) and kept.groupBy("doc_id").count().filter("count > 1").count() == 0
