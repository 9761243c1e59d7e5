import random

from pyspark.sql import functions as F

from spanlight.llm import queries, url_filters
from spanlight.llm.url_filters import judge_urls, split_url


def test_split_url():
    assert split_url("HTTP://User@ExÀmple.COM:80/A/b?c=/d#e") == ("user@exÀmple.com:80", "/A/b")
    assert split_url("http://a.b?x/y") == ("a.b", "") and split_url("x://h#/p") == ("h", "")
    assert split_url("a.b/c") == ("", "") and split_url(None) == ("", "") and split_url("://") == ("", "")
    assert split_url("http://a/b://c/d") == ("a", "/b://c/d")


def plain(url, rules, default="allow"):
    host, path = split_url(url)
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            if best is None or (len(rule.encode()), verdict == "block") > (len(best[1].encode()), best[0] == "block"):
                best = (verdict, rule)
    return (host, path, best[1] if best else None, best[0] if best else default)


def test_random_rules_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(1)
    part = lambda: rng.choice(["a", "b", "com", "é"])
    host = lambda: ".".join(part() for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join(rng.choice(["/", "/x", "/en/", "y"]) for _ in range(rng.randrange(3)))
    rules = sorted({host() + "/" + path().lstrip("/") for _ in range(60)} | {"b.com"})
    rules = [(rng.choice(["allow", "block"]), r) for r in rules]
    urls = [(i, f"http://{host()}{rng.choice(['', '/' + path().lstrip('/')])}{rng.choice(['', '?q', '#f'])}") for i in range(500)]
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    want = {(i, *plain(u, rules)) for i, u in urls}
    assert {tuple(r) for r in judge_urls(df, rules).collect()} == want
    assert {tuple(r) for r in judge_urls(df, rules, max_bytes=100).collect()} == want


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filters, "digest", lambda x: len(x))
    url_filters.write_array(tmp_path / "a", [(b"aa/", True), (b"bb/", False), (b"cc/", True)])
    a = url_filters.DigestArray(tmp_path / "a")
    assert list(a.probe([b"bb/", b"dd/", b"cc/", b"x"])) == [1, -1, 2, -1]


def test_query(spark):
    path = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    found = {tuple(r) for r in queries.op3_url_filters(spark, path).collect()}
    assert found == {(p.page_id, *plain(p.url, queries.URL_RULES)) for p in pages}
    assert len({r[3] for r in found}) >= 5
    assert {tuple(r) for r in queries.op3_url_filters(spark, path).collect()} == found  # the same rules again


def test_edges(spark):
    schema = "page_id long, url string"
    assert judge_urls(spark.createDataFrame([], schema), [("block", "com/")]).collect() == []
    rows = [(None, None), (1, ""), (1, "com/"), (2, "x://com"), (3, "x://a.com/" + "y" * 10**6), (3, "x://a.com/")]
    df = spark.createDataFrame(rows, schema).withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    assert [r.verdict for r in judge_urls(df, []).collect()] == ["allow"] * 6
    assert [(r.rule, r.verdict) for r in judge_urls(df, [("allow", "com/"), ("block", "com/")]).collect()] == [(None, "allow")] * 4 + [("com/", "block")] * 2


def test_rules_as_a_table_with_long_paths_and_nulls(spark):
    deep = "/" + "d" * 80
    rows = [("block", f"h{k}.com/p{k}/") for k in range(3000)] + [("block", "long.org" + deep), ("allow", "long.org" + deep + "/x"), ("block", None), (None, "odd.org/"), ("block", "EN.Wiki.org/A")]
    urls = [(k, f"https://www.h{k}.com/p{k if k % 2 else 'x'}/q") for k in range(0, 3000, 7)]
    urls += [(-1, "x://long.org" + deep + "/y"), (-2, "x://a.long.org" + deep + "/x/z"), (-3, "x://long.org/" + "d" * 70), (-4, "x://odd.org/"), (-5, "x://en.wiki.ORG/A"), (-6, "x://en.wiki.org/a")]
    rules = spark.createDataFrame(rows, "verdict string, rule string").repartition(5).withColumn("extra", F.lit(1))
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules, max_bytes=20_000).collect()}
    for k in range(0, 3000, 7):
        assert got[k] == ((f"h{k}.com/p{k}/", "block") if k % 2 else (None, "allow"))
    assert [got[-k] for k in range(1, 7)] == [("long.org" + deep, "block"), ("long.org" + deep + "/x", "allow"), (None, "allow"), ("odd.org/", "allow"), ("en.wiki.org/A", "block"), (None, "allow")]
