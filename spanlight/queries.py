"""Registered queries over the given tables, and the DuckDB SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import patterns as P
from .functions import text as T
from .functions.structure import CONTENT, CURRENT, END_DICE, GENERIC, LINKING, LONGEST, PREDICATES, START_DICE, WORD_DICE, fuzzy, structure
from .operators import events as E
from .operators import intervals as I
from .operators import signals as S
from .operators import windows as WN
from .sources import captions as C
from .sources import samples as D
from .sources.samples import sample
from .sources.tables import settled, shared_path, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = D.in_duckdb(sql)
        return f

    return put


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark, sf_dir, D.CAPTIONS, "user_id")


def joined(c: str):
    return F.array_join(c, ",").alias(c)


CAP, TRUE_, LOC, COM, ANS = (f"({s})" for s in (D.CAPTIONS, D.TRUTH, D.LOCAL, D.COMMUNITY, D.ANSWERS))
NORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


def picked(cases: dict[str, str]) -> str:
    """SQL for the sorted names whose condition holds, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cases[g]} THEN '{g}' END" for g in sorted(cases)) + ")"


# Sources


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captions of each video as one JSON payload; every fifth video's payload is broken in some way."""
    event = F.struct(F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"), F.array(F.struct(F.substring("text", 1, 9).alias("utf8")), F.struct(F.concat(F.substring(F.col("text"), F.lit(10), F.length("text")), F.lit(" \n")).alias("utf8"))).alias("segs"))
    whole = captions(spark, sf_dir).groupBy("video_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(event)).alias("events"))).alias("body"))
    k = F.col("video_id") % 10
    return whole.withColumn("body", F.when(k == 5, "<xml/>").when(k == 6, '{"events":[]}').when(k == 7, F.lit(None)).otherwise(F.col("body")))


@query(f"SELECT video_id, start_ms, end_ms, {r"trim(regexp_replace(text, '\s+', ' ', 'g'))"} AS text FROM {CAP} WHERE video_id % 10 NOT IN (5, 6, 7)")
def s1_parse_captions(spark, sf_dir):
    return C.parse_captions(payloads(spark, sf_dir))


@query("SELECT DISTINCT user_id AS video_id, CASE user_id % 10 WHEN 5 THEN 'fetch-error' WHEN 7 THEN 'fetch-error' WHEN 6 THEN 'unavailable' ELSE 'ok' END AS status FROM {events}")
def s2_payload_status(spark, sf_dir):
    return C.payload_status(payloads(spark, sf_dir))


COMMUNITY_MS = f"SELECT video_id, start_s * 1000 AS start_ms, end_s * 1000 AS end_ms FROM {COM} x WHERE category = 'sponsor' AND coalesce(action_type, 'skip') = 'skip' AND start_s >= 0 AND end_s > start_s"


def community(spark, sf_dir):
    rows = sample(spark, sf_dir, D.COMMUNITY)
    return C.community_segments(rows.select("video_id", F.array("start_s", "end_s").alias("segment"), "category", "action_type"))


@query(COMMUNITY_MS)
def s3_community_segments(spark, sf_dir):
    return community(spark, sf_dir)


# Text functions


@query(f"SELECT video_id, start_ms, end_ms, category FROM ({D.TRUTH}) t")
def s4_write_segments(spark, sf_dir):
    """The segments as they are read back from what was written."""
    path = shared_path(spark, "segments")
    C.write_segments(truth(spark, sf_dir).select("video_id", "start_ms", "end_ms", "category"), path)
    return spark.read.parquet(path)


@query(f"SELECT video_id, event_idx, {NORM} AS normalized, trim(regexp_replace({NORM}, '[^a-z0-9%$]+', ' ', 'g')) AS fuzzy FROM {CAP}")
def p1_p2_normalize_text(spark, sf_dir):
    n = T.normalize_text(F.col("text"))
    return captions(spark, sf_dir).select("video_id", "event_idx", n.alias("normalized"), T.normalize_fuzzy(n).alias("fuzzy"))


@query(
    f"""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, text) - 1 AS event_idx, start_ms, end_ms, text
    FROM (SELECT DISTINCT video_id, start_ms, end_ms, text FROM {CAP} WHERE event_id % 11 <> 0) d"""
)
def p3_clean_events(spark, sf_dir):
    c = captions(spark, sf_dir)
    text = F.when(F.col("event_id") % 11 == 0, "  ").otherwise(F.col("text"))
    twice = c.withColumn("text", text).unionByName(c.filter("event_id % 5 = 0 and event_id % 11 <> 0"))
    return E.clean_events(twice)


_GROUPS = {g: P.re2(p, "n") for g, p in P.SIGNALS.items()}
_AGAINST = {g: P.re2(p, "n") for g, p in P.NEGATIVES.items()}
_CODES = f"(strpos(n, 'code') > 0 AND (regexp_matches(text, '{P.CODE_LABELLED}') OR regexp_matches(text, '{P.CODE_OWNED}') OR regexp_matches(text, '{P.CODE_UPPER}')))"
FLAG_SQL = {
    "strong": P.re2(P.STRONG_START, "n"),
    "contextual": P.re2(P.CONTEXTUAL_START, "n"),
    "endorsement_start": P.re2(P.ENDORSEMENT_START, "n"),
    "self_promotion_start": P.re2(P.SELF_PROMOTION_START, "n"),
    "ends_before": P.re2(P.END_BEFORE, "n"),
    "finishes": P.re2(P.END, "n"),
    "self_promotion": P.re2(P.SELF_PROMOTION, "n"),
    **{f"g_{g}": c for g, c in _GROUPS.items()},
    **{f"n_{g}": c for g, c in _AGAINST.items()},
}


def scored_sql(source: str, keep: str) -> str:
    """SQL of signals.features over (keep, text); fuzzy rules find nothing more in these texts."""
    total = " + ".join(f"{w} * CAST({g} AS INT)" for g, w in P.WEIGHTS.items() if g != "brand")
    minus = " + ".join(f"{w} * CAST(n_{g} AS INT)" for g, w in P.NEGATIVE_WEIGHTS.items())
    return f"""
    SELECT *, greatest(0, total - negative) AS commercial, greatest(0, positive - negative) AS score FROM (
      SELECT *, total + 12 * CAST(starts AS INT) + 4 * CAST(ends AS INT) AS positive FROM (
        SELECT *, strong_start OR contextual_start OR self_promotion_start AS starts, {total} AS total, {minus} AS negative,
               {picked({g: g for g in P.SIGNALS})} AS groups, {picked({g: "n_" + g for g in P.NEGATIVES})} AS negative_groups FROM (
          SELECT *, g_sponsor AND NOT n_explicitNegation AS sponsor, g_code OR {_CODES} AS code, strong AND NOT n_explicitNegation AS strong_start,
                 contextual AND NOT n_explicitNegation AS contextual_start, ends_before OR finishes AS ends,
                 {", ".join(f"g_{g} AS {g}" for g in P.SIGNALS if g not in ("sponsor", "code"))} FROM (
            SELECT {keep}, text, n, {", ".join(f"{c} AS {k}" for k, c in FLAG_SQL.items())} FROM (SELECT *, {NORM} AS n FROM {source} s) a) b) c) d) e"""


SCORED = scored_sql(CAP, "video_id, event_idx, start_ms, end_ms")


def scored(spark, sf_dir):
    return S.text_features(captions(spark, sf_dir))


@query(f"SELECT video_id, event_idx, groups FROM ({SCORED}) s")
def p4_signal_groups(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "event_idx", joined("groups"))


@query(f"SELECT video_id, event_idx, negative_groups FROM ({SCORED}) s")
def p5_negative_groups(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "event_idx", joined("negative_groups"))


@query(f"SELECT video_id, event_idx, strong_start, contextual_start, endorsement_start, self_promotion_start, ends, ends_before, self_promotion FROM ({SCORED}) s")
def p6_boundary_flags(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "event_idx", "strong_start", "contextual_start", "endorsement_start", "self_promotion_start", "ends", "ends_before", "self_promotion")


@query(f"SELECT video_id, event_idx, positive, negative, score, commercial, starts FROM ({SCORED}) s")
def p16_features(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "event_idx", "positive", "negative", "score", "commercial", "starts")


def _list(found: str) -> str:
    return f"array_to_string(list_sort(list_distinct({found})), ',')"


_NOT = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(P.NO_BRANDS)) + "]"


@query(
    f"""SELECT video_id, event_idx, CASE WHEN strpos(n, 'code') = 0 THEN '' ELSE {_list(f"list_transform(list_concat(regexp_extract_all(text, '{P.CODE_LABELLED}', 1), regexp_extract_all(text, '{P.CODE_OWNED}', 1), regexp_extract_all(text, '{P.CODE_UPPER}', 1), CASE WHEN regexp_matches(n, '{P.OFFER_CONTEXT}') THEN regexp_extract_all(n, '{P.CODE_PLAIN}', 1) ELSE [] END), lambda x: lower(x))")} END AS codes
    FROM (SELECT *, {NORM} AS n FROM {CAP} s) t"""
)
def p7_promo_codes(spark, sf_dir):
    return captions(spark, sf_dir).select("video_id", "event_idx", F.array_join(T.promo_codes(F.col("text"), T.normalize_text(F.col("text"))), ",").alias("codes"))


@query(
    f"""SELECT video_id, event_idx, {_list(f"list_filter(regexp_extract_all(n, '{P.DOMAIN_ROOT}', 1), lambda x: NOT list_contains({_NOT}, x))")} AS roots,
    {_list(f"list_filter([{', '.join(f"regexp_extract(n, '{p}', 1)" for p in P.NAMED_BRAND)}], lambda x: x <> '' AND NOT list_contains({_NOT}, x))")} AS names
    FROM (SELECT *, {NORM} AS n FROM {CAP} s) t"""
)
def p8_p9_brand_names(spark, sf_dir):
    n = T.normalize_text(F.col("text"))
    return captions(spark, sf_dir).select("video_id", "event_idx", F.array_join(T.domain_roots(n), ",").alias("roots"), F.array_join(T.named_brands(n), ",").alias("names"))


_CAPITALS = f"list_filter(list_transform(regexp_extract_all(text, '{P.CAPITALISED}'), lambda x: lower(x)), lambda x: NOT list_contains({_NOT}, x) AND NOT list_contains(string_split(codes, ','), x))"


@query(
    f"""SELECT video_id, event_idx, CASE WHEN sponsor OR code OR offer OR url OR legal THEN {_list(_CAPITALS)} ELSE '' END AS brands
    FROM ({SCORED}) s JOIN ({SQL["p7_promo_codes"]}) c USING (video_id, event_idx)"""
)
def p10_capitalized_brands(spark, sf_dir):
    cue = F.arrays_overlap("groups", F.array(*map(F.lit, (*P.PRECISE, "sponsor"))))
    return scored(spark, sf_dir).select("video_id", "event_idx", F.array_join(T.capitalized_brands(F.col("text"), cue, F.col("codes")), ",").alias("brands"))


_WORDS = r"(SELECT DISTINCT unnest(string_split_regex(lower(c_name), '[^a-z0-9]+')) AS word FROM customer UNION SELECT unnest(['sponsr', 'sponsered', 'sponsors', 'sponsoring', 'response', 'spons', 'sensor']))"
_GRAMS = "(SELECT word, substr(' ' || word || ' ', i, 3) AS gram, count(*) AS n FROM {words}, range(1, 200) r(i) WHERE word <> '' AND i <= length(word) GROUP BY ALL)"


@query(
    f"""WITH words AS (SELECT word FROM {_WORDS} w WHERE word <> ''),
    targets AS (SELECT unnest(['sponsor', 'sponsored', 'sponsoring', 'sponsorship']) AS word),
    wg AS {_GRAMS.format(words="words")}, tg AS {_GRAMS.format(words="targets")},
    shared AS (SELECT wg.word, tg.word AS target, sum(least(wg.n, tg.n)) AS n FROM wg JOIN tg USING (gram) GROUP BY ALL)
    SELECT w.word, t.word AS target, CASE WHEN w.word = t.word THEN 1.0 ELSE 2.0 * coalesce(n, 0) / (length(w.word) + length(t.word)) END AS dice,
           length(w.word) >= 6 AND CASE WHEN w.word = t.word THEN 1.0 ELSE 2.0 * coalesce(n, 0) / (length(w.word) + length(t.word)) END >= 0.78 AS alike
    FROM words w CROSS JOIN targets t LEFT JOIN shared s ON s.word = w.word AND s.target = t.word"""
)
def p11_p12_dice(spark, sf_dir):
    """Every distinct word of the customers' names, and some near-misses, against the four sponsor words."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.explode(F.split(F.lower("c_name"), "[^a-z0-9]+")).alias("word"))
    near = spark.createDataFrame([(w,) for w in "sponsr sponsered sponsors sponsoring response spons sensor".split()], "word string")
    words = names.union(near).filter("word <> ''").distinct()
    pairs = spread(words, "word").withColumn("target", F.explode(F.array(*map(F.lit, ("sponsor", "sponsored", "sponsoring", "sponsorship")))))
    pairs = pairs.select("word", "target", T.dice(F.col("word"), F.col("target")).alias("dice"))
    return pairs.withColumn("alike", (F.length("word") >= 6) & (F.col("dice") >= 0.78))


_FUZZY = ", ".join(f"('{kind}', '{fuzzy(p)}', {least})" for kind, phrases, least in (("start", P.FUZZY_START_PHRASES, START_DICE), ("end", P.FUZZY_END_PHRASES, END_DICE)) for p in phrases)
_IN = lambda names: ", ".join(f"'{w}'" for w in sorted(names))


@query(
    f"""WITH talk AS (SELECT *, {NORM} AS n FROM ({D.TALK}) x),
    texts AS (SELECT n, trim(regexp_replace(n, '[^a-z0-9%$]+', ' ', 'g')) AS clean, list_filter(string_split(trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM (SELECT DISTINCT n FROM talk) d),
    spoken AS (SELECT n, unnest(string_split(clean, ' ')) AS word FROM texts),
    asked(kind, phrase, least) AS (VALUES {_FUZZY}),
    sized AS (SELECT *, len(string_split(phrase, ' ')) AS size FROM asked),
    runs AS (SELECT DISTINCT t.n, kind, phrase, least, array_to_string(list_slice(string_split(clean, ' '), i, i + k - 1), ' ') AS run
             FROM texts t, sized p, range(1, 40) a(i), range(2, 20) b(k)
             WHERE clean <> '' AND length(clean) <= {LONGEST} AND k >= size - 1 AND k <= least(len(string_split(clean, ' ')), size + 2) AND i + k - 1 <= len(string_split(clean, ' '))),
    strings AS (SELECT run AS word FROM runs UNION SELECT phrase FROM asked UNION SELECT word FROM spoken UNION SELECT unnest([{_IN(T.SPONSOR_WORDS)}])),
    grams AS {_GRAMS.format(words="strings")},
    pairs AS (SELECT DISTINCT run AS a, phrase AS b FROM runs UNION SELECT s.word, t.word FROM spoken s, (SELECT unnest([{_IN(T.SPONSOR_WORDS)}]) AS word) t WHERE length(s.word) >= 6),
    alike AS (SELECT a, b, 2.0 * sum(least(x.n, y.n)) / (length(a) + length(b)) AS dice FROM pairs JOIN grams x ON x.word = a JOIN grams y ON y.word = b AND y.gram = x.gram GROUP BY a, b),
    w AS (SELECT DISTINCT s.n FROM spoken s JOIN alike ON a = s.word AND length(s.word) >= 6 AND b IN ({_IN(T.SPONSOR_WORDS)}) AND dice >= {WORD_DICE}),
    f AS (SELECT DISTINCT kind, r.n FROM runs r JOIN alike ON a = run AND b = phrase AND dice >= least
          UNION SELECT kind, n FROM texts, asked WHERE length(clean) <= {LONGEST} AND strpos(clean, phrase) > 0),
    placed AS (SELECT n, words, unnest(range(1, len(words) + 1)) AS i FROM texts),
    c AS (SELECT * FROM placed WHERE words[i] IN ({_IN(CONTENT)}) AND list_has_any(list_slice(words, greatest(1, i - 2), i + 2), [{_IN(CURRENT)}])),
    s AS (SELECT *, list_slice(words, greatest(1, i - 6), i - 1) AS before FROM placed WHERE regexp_full_match(words[i], 'sponsor(s|ed|ing|ship)?')),
    starts AS (SELECT DISTINCT s.n FROM s JOIN c ON c.n = s.n AND abs(s.i - c.i) <= 8
               AND CASE WHEN c.i < s.i THEN NOT list_contains(before, 'about') AND list_has_any(before, [{_IN(LINKING)}]) ELSE list_has_any(list_slice(s.words, s.i + 1, c.i - 1), ['of', 'for']) END),
    r AS (SELECT n, words[i] AS word, list_slice(words, i + 1, len(words)) AS rest FROM placed WHERE i > 1 AND words[i] IN ('sponsor', 'sponsors') AND words[i - 1] IN ('our', 'the')),
    k AS (SELECT *, CASE WHEN len(rest) > 1 AND rest[1] = 'such' AND rest[2] = 'as' THEN 2 WHEN len(rest) > 0 AND rest[1] IN ('like', 'including', 'is') THEN 1 ELSE 0 END AS skip FROM r),
    roles AS (SELECT DISTINCT n FROM k WHERE CASE WHEN len(rest) = 0 THEN word = 'sponsors' WHEN skip > 0 THEN len(rest) > skip AND rest[skip + 1] NOT IN ({_IN(GENERIC)})
              ELSE rest[1] NOT IN ({_IN(GENERIC)}) AND list_has_any(list_slice(rest, 2, 7), [{_IN(PREDICATES)}]) END)
    SELECT video_id, event_idx, n IN (SELECT n FROM w) AS fuzzy_word, n IN (SELECT n FROM w) AND n IN (SELECT n FROM f WHERE kind = 'start') AS fuzzy_start,
           {P.re2([P.FUZZY_END_GATE], "n")} AND n IN (SELECT n FROM f WHERE kind = 'end') AS fuzzy_end, n IN (SELECT n FROM starts) AS structural_start, n IN (SELECT n FROM roles) AS structural_role FROM talk"""
)
def p12_p15_word_rules(spark, sf_dir):
    """The rules that jobs use, on captions that meet and that narrowly miss each of them."""
    rows = sample(spark, sf_dir, D.TALK)
    return rows.select("video_id", "event_idx", structure(T.normalize_text(F.col("text"))).alias("r")).select("video_id", "event_idx", "r.*")


@query(
    f"""SELECT video_id, event_idx, CASE WHEN self_promotion AND NOT affiliate AND NOT sponsor THEN 'self-promotion' WHEN starts THEN 'paid-sponsor' WHEN affiliate AND NOT sponsor THEN 'affiliate'
    WHEN sponsor OR code OR offer OR url OR legal THEN 'paid-sponsor' ELSE 'commercial-unknown' END AS category FROM ({SCORED}) s WHERE commercial > 0"""
)
def p17_classify(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("commercial > 0")
    return rows.select("video_id", "event_idx", S.classify(F.col("starts"), F.col("self_promotion"), F.col("affiliate"), F.lit(True), F.col("groups")).alias("category"))


@query(f"SELECT video_id, event_idx, start_ms, end_ms, category FROM {LOC} s WHERE end_ms - start_ms BETWEEN 8000 AND 180000 AND category IN ('paid-sponsor', 'affiliate', 'commercial-unknown', 'self-promotion')")
def p18_keep_segments(spark, sf_dir):
    from .jobs.detect import keep_segments

    return keep_segments(sample(spark, sf_dir, D.LOCAL)).select("video_id", "event_idx", "start_ms", "end_ms", "category")


@query(
    f"""SELECT video_id, least(d, greatest(0, s)) / d * 100 AS left_percent, (least(d, greatest(least(d, greatest(0, s)), e)) - least(d, greatest(0, s))) / d * 100 AS width_percent
    FROM (SELECT video_id, start_ms / 1000 AS s, end_ms / 1000 AS e, max(end_ms) OVER (PARTITION BY video_id) / 1000 * 0.9 AS d FROM {LOC} l) x
    WHERE least(d, greatest(least(d, greatest(0, s)), e)) > least(d, greatest(0, s))"""
)
def p19_timeline_markers(spark, sf_dir):
    segs = sample(spark, sf_dir, D.LOCAL).select("video_id", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))
    return I.timeline_markers(segs, segs.groupBy("video_id").agg((F.max("end_s") * 0.9).alias("duration_s")))


@query("SELECT event_id, concat(CAST(floor(value * 10 + 0.5) AS BIGINT), ':', CAST(floor(value * CAST(1.7 AS DOUBLE) * 10 + 0.5) AS BIGINT)) AS seg_key FROM {events}")
def p20_segment_key(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", T.segment_key(F.col("value"), F.col("value") * 1.7).alias("seg_key"))


@query(
    """SELECT event_id, CASE WHEN r < 60 THEN concat(r, 's') WHEN r % 60 = 0 THEN concat(r // 60, 'm') ELSE concat(r // 60, 'm ', r % 60, 's') END AS shown
    FROM (SELECT event_id, CAST(floor(greatest(value * 10, 0) + 0.5) AS BIGINT) AS r FROM {events}) e"""
)
def p21_format_duration(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.format_duration(F.col("value") * 10).alias("shown"))


HANDLES = "(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('@', c_name) WHEN 1 THEN concat(' ', upper(c_name), ' ') WHEN 2 THEN ' ' ELSE lower(c_name) END AS handle FROM customer)"


def handles(spark, sf_dir):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("@"), "c_name")).when(k == 1, F.concat(F.lit(" "), F.upper("c_name"), F.lit(" "))).when(k == 2, " ").otherwise(F.lower("c_name"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", raw.alias("handle"))


@query(f"SELECT c_custkey, CASE WHEN trim(handle) = '' THEN '' WHEN trim(handle) LIKE '@%' THEN lower(trim(handle)) ELSE concat('@', lower(trim(handle))) END AS normal FROM {HANDLES} h")
def p22_normalize_handle(spark, sf_dir):
    return handles(spark, sf_dir).select("c_custkey", T.normalize_handle(F.col("handle")).alias("normal"))


@query(
    r"""SELECT page_id, nullif(CASE WHEN path = '/watch' THEN regexp_extract(url, '^[^?#]*\?(?:[^#]*&)?v=([^&#]*)', 1) ELSE regexp_extract(path, '^/(?:shorts|embed)/([^/?]+)', 1) END, '') AS video_id
    FROM (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://v.example/watch?a=1&v=', page_id, '&t=3') WHEN 1 THEN concat('https://v.example/shorts/s', page_id, '?x') WHEN 2 THEN concat('https://v.example/embed/', page_id) ELSE url END AS url FROM pages) p) q"""
)
def p23_video_id_from_url(spark, sf_dir):
    p, k = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), F.col("page_id") % 4
    s = F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://v.example/watch?a=1&v="), s, F.lit("&t=3"))).when(k == 1, F.concat(F.lit("https://v.example/shorts/s"), s, F.lit("?x"))).when(k == 2, F.concat(F.lit("https://v.example/embed/"), s)).otherwise(F.col("url"))
    return p.select("page_id", T.video_id_from_url(url).alias("video_id"))


# Windows over captions


@query(
    f"""WITH c AS (SELECT * FROM {CAP} x),
    two AS (SELECT a.video_id, a.event_idx AS start_idx, k AS size, a.start_ms FROM c a, range(1, 5) r(k))
    SELECT t.video_id, t.start_idx, CAST(t.start_idx + size - 1 AS INT) AS end_idx, string_agg(c.text, ' ' ORDER BY c.event_idx) AS text
    FROM two t JOIN c ON c.video_id = t.video_id AND c.event_idx BETWEEN t.start_idx AND t.start_idx + size - 1
    GROUP BY t.video_id, t.start_idx, size, t.start_ms HAVING count(*) = size AND (size = 1 OR max(c.end_ms) FILTER (c.event_idx > t.start_idx) - t.start_ms <= 24000)"""
)
def w1_caption_spans(spark, sf_dir):
    """Captions are 8 seconds long here, so spans of up to 24 seconds are taken."""
    from .options import DetectorOptions

    return E.caption_spans(captions(spark, sf_dir), DetectorOptions(max_span=24_000))


_UNITED = "(PARTITION BY video_id, end_idx ORDER BY start_idx < end_idx, start_idx ROWS UNBOUNDED PRECEDING)"
_SHOWN_FLAGS = ("starts", "strong_start", "contextual_start", "endorsement_start", "self_promotion_start", "ends", "ends_before", "self_promotion", "negated", "affiliate")


@query(
    f"""WITH s AS (SELECT *, n_explicitNegation AS negated FROM ({scored_sql(f"({SQL['w1_caption_spans']})", "video_id, start_idx, end_idx")}) x),
    shown AS (SELECT * FROM s WHERE groups <> '' OR negative_groups <> '' OR {" OR ".join(_SHOWN_FLAGS)}),
    so_far AS (SELECT *, {", ".join(f"bool_or({g}) OVER {_UNITED} AS u_{g}" for g in P.SIGNALS)}, max(negative) OVER {_UNITED} AS least FROM shown),
    folded AS (SELECT video_id, end_idx, greatest(0, max(CASE WHEN start_idx = end_idx THEN commercial ELSE {" + ".join(f"{w} * CAST(u_{g} AS INT)" for g, w in P.WEIGHTS.items() if g != "brand")} - least END)) AS commercial,
               {", ".join(f"bool_or({g}) AS o_{g}" for g in P.SIGNALS)}, {", ".join(f"bool_or(n_{g}) AS m_{g}" for g in P.NEGATIVES)}, {", ".join(f"bool_or({k}) AS f_{k}" for k in _SHOWN_FLAGS)}, count(*) FILTER (ends) AS closing
               FROM so_far GROUP BY ALL),
    opened AS (SELECT video_id, start_idx, count(*) AS opening FROM shown WHERE starts GROUP BY ALL)
    SELECT c.video_id, c.event_idx, {picked({g: "o_" + g for g in P.SIGNALS})} AS groups, {picked({g: "m_" + g for g in P.NEGATIVES})} AS negative_groups, CAST(coalesce(commercial, 0) AS INT) AS commercial,
           {", ".join(f"coalesce(f_{k}, false) AS {k}" for k in _SHOWN_FLAGS)}, CAST(coalesce(closing, 0) AS INT) AS end_spans, CAST(coalesce(opening, 0) AS INT) AS start_spans
    FROM {CAP} c LEFT JOIN folded f ON f.video_id = c.video_id AND f.end_idx = c.event_idx LEFT JOIN opened o ON o.video_id = c.video_id AND o.start_idx = c.event_idx"""
)
def w2_span_features(spark, sf_dir):
    """Captions are 8 seconds long here, so spans of up to 24 seconds are taken."""
    from .jobs.detect import span_features
    from .options import DetectorOptions

    found = span_features(captions(spark, sf_dir), DetectorOptions(max_span=24_000))
    sizes = [F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ("end_spans", "start_spans")]
    return found.select("video_id", "event_idx", joined("groups"), joined("negative_groups"), "commercial", *_SHOWN_FLAGS, *sizes)


_ENDS = f"SELECT w.video_id, w.start_idx, w.end_idx, c.end_ms FROM (SELECT *, {NORM} AS n FROM ({SQL['w1_caption_spans']}) x) w JOIN {CAP} c ON c.video_id = w.video_id AND c.event_idx = w.end_idx WHERE {P.re2(P.END, 'n')} OR {P.re2(P.END_BEFORE, 'n')}"


@query(
    f"""SELECT c.video_id, c.event_idx AS candidate_idx, e.end_idx, max(e.start_idx) AS start_idx FROM {CAP} c JOIN ({_ENDS}) e ON e.video_id = c.video_id AND e.start_idx >= c.event_idx AND e.end_ms - c.start_ms >= 8000
    WHERE c.phase = 8 GROUP BY ALL"""
)
def w9_pick_end_spans(spark, sf_dir):
    spans, c = w1_caption_spans(spark, sf_dir), captions(spark, sf_dir)
    n = T.normalize_text(F.col("text"))
    ends = spans.filter(T.matches(n, P.END) | T.matches(n, P.END_BEFORE)).drop("text").join(c.select("video_id", F.col("event_idx").alias("end_idx"), "end_ms"), ["video_id", "end_idx"])
    return WN.pick_end_spans(c.filter("phase = 8").select("video_id", F.col("event_idx").alias("candidate_idx"), F.col("start_ms").alias("candidate_ms")), ends)


@query(
    f"""WITH f AS ({SCORED}), e AS (SELECT f.*, least(event_idx, (SELECT count(*) FROM f b WHERE b.video_id = f.video_id AND b.start_ms < f.end_ms - 50000)) AS before FROM f),
    l AS (SELECT *, max(before) OVER (PARTITION BY video_id ORDER BY event_idx) AS left_idx FROM e),
    w AS (SELECT l.video_id, l.event_idx, l.left_idx, {", ".join(f"max(CAST(f.{g} AS INT)) AS {g}" for g in P.SIGNALS)}
          FROM l JOIN f ON f.video_id = l.video_id AND f.event_idx BETWEEN l.left_idx AND l.event_idx AND f.commercial > 0 GROUP BY ALL),
    s AS (SELECT *, {" + ".join(f"{w} * {g}" for g, w in P.WEIGHTS.items() if g != "brand")} AS score, {" + ".join(P.SIGNALS)} AS n FROM w),
    q AS (SELECT *, event_idx - row_number() OVER (PARTITION BY video_id ORDER BY event_idx) AS run FROM s WHERE score >= 12 AND n >= 2 AND greatest(code, offer, url, legal) = 1)
    SELECT video_id, CAST(left_idx AS INT) AS start_idx, event_idx AS end_idx, score FROM q
    QUALIFY row_number() OVER (PARTITION BY video_id, run ORDER BY score DESC, left_idx DESC, event_idx) = 1"""
)
def w4_evidence_windows(spark, sf_dir):
    return WN.evidence_windows(scored(spark, sf_dir).select("video_id", "event_idx", "start_ms", "end_ms", "commercial", "groups"))


@query(
    f"""WITH f AS ({SCORED}), codes AS (SELECT video_id, event_idx, unnest(string_split(codes, ',')) AS brand FROM ({SQL["p7_promo_codes"]}) x WHERE codes <> ''),
    strong AS (SELECT video_id, event_idx, unnest(string_split(concat_ws(',', nullif(roots, ''), nullif(names, '')), ',')) AS brand, 3 AS strength FROM ({SQL["p8_p9_brand_names"]}) x WHERE roots <> '' OR names <> ''),
    weak AS (SELECT * FROM (SELECT video_id, event_idx, unnest(string_split(brands, ',')) AS brand, 2 AS strength FROM ({SQL["p10_capitalized_brands"]}) x WHERE brands <> '') y
             WHERE NOT EXISTS (SELECT 1 FROM codes c WHERE c.video_id = y.video_id AND c.brand = y.brand)),
    seeds AS (SELECT s.video_id, s.event_idx, brand, strength, start_ms FROM (SELECT * FROM strong UNION SELECT * FROM weak) s JOIN f USING (video_id, event_idx)),
    said AS (SELECT DISTINCT video_id, event_idx, start_ms, end_ms, unnest(regexp_extract_all(n, '{P.TOKEN}')) AS brand FROM f),
    m AS (SELECT s.*, start_ms - lag(end_ms) OVER (PARTITION BY video_id, brand ORDER BY event_idx) AS gap FROM said s WHERE EXISTS (SELECT 1 FROM seeds d WHERE d.video_id = s.video_id AND d.brand = s.brand)),
    near AS (SELECT DISTINCT m.video_id, m.event_idx, m.brand FROM m JOIN seeds d ON d.video_id = m.video_id AND d.brand = m.brand AND abs(m.start_ms - d.start_ms) <= 90000
             WHERE EXISTS (SELECT 1 FROM m k WHERE k.video_id = m.video_id AND k.brand = m.brand AND k.gap <= 90000))
    SELECT n.video_id, n.event_idx, string_agg(n.brand, ',' ORDER BY n.brand) AS brands,
           CAST(sum(CASE WHEN (SELECT max(strength) FROM seeds d WHERE d.video_id = n.video_id AND d.brand = n.brand) >= 3 THEN 4 ELSE 3 END) AS INT) AS boost
    FROM near n GROUP BY n.video_id, n.event_idx"""
)
def w3_repeated_brands(spark, sf_dir):
    rows = scored(spark, sf_dir).select("video_id", "event_idx", "start_ms", "end_ms", "text", "normalized", "codes", "groups")
    return WN.repeated_brands(settled(rows, "scored")).select("video_id", "event_idx", joined("brands"), "boost")


@query(
    f"""SELECT video_id, pos, language_code, kind, base_url FROM ({D.TRACKS}) t QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY
    CASE WHEN language_code = 'en' AND coalesce(kind, '') <> 'asr' THEN 0 WHEN language_code = 'en' THEN 1 WHEN language_code LIKE 'en%' THEN 2 WHEN coalesce(kind, '') <> 'asr' THEN 3 ELSE 4 END, pos) = 1"""
)
def w6_choose_track(spark, sf_dir):
    return WN.choose_track(sample(spark, sf_dir, D.TRACKS))


CURRENT = f"""SELECT tab_id, seq, action, video_id, body, generation FROM (SELECT *, max(CASE WHEN action = 'VIDEO_CHANGED' THEN video_id END) OVER (PARTITION BY tab_id, generation) AS now FROM (
      SELECT *, count(*) FILTER (action IN ('VIDEO_CHANGED', 'CHANNEL_BLOCKED')) OVER (PARTITION BY tab_id ORDER BY seq) AS generation FROM ({D.MESSAGES}) m) y) x
    WHERE action NOT IN ('VIDEO_CHANGED', 'CHANNEL_BLOCKED') AND video_id = now"""


@query(CURRENT)
def j10_messages_for_current_video(spark, sf_dir):
    return WN.messages_for_current_video(sample(spark, sf_dir, D.MESSAGES)).select("tab_id", "seq", "action", "video_id", "body", "generation")


@query(f"SELECT * FROM ({CURRENT}) c QUALIFY coalesce(body <> lag(body) OVER (PARTITION BY tab_id, video_id, generation, action ORDER BY seq), true)")
def w7_drop_repeats(spark, sf_dir):
    return WN.drop_repeats(j10_messages_for_current_video(spark, sf_dir))


RUNNING = f"""SELECT user_id, seq, ts, n - least(0, min(n) OVER w) AS skipped, CAST(t - least(0, min(t) OVER w) AS DOUBLE) AS time_s FROM (
      SELECT user_id, seq, ts, sum(CASE action WHEN 'RECORD' THEN 1 ELSE -1 END) OVER w AS n, sum(CASE action WHEN 'RECORD' THEN 1 ELSE -1 END * CAST(duration_s AS DECIMAL(28, 6))) OVER w AS t
      FROM ({D.SKIPS}) s WHERE duration_s > 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)) r WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)"""


@query(f"SELECT user_id, seq, skipped, time_s FROM ({RUNNING}) r")
def w8_running_skip_stats(spark, sf_dir):
    return WN.running_skip_stats(sample(spark, sf_dir, D.SKIPS)).select("user_id", "seq", "skipped", "time_s")


@query(f"SELECT user_id, skipped, time_s FROM ({RUNNING}) r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) = 1")
def a8_skip_totals(spark, sf_dir):
    return WN.skip_totals(sample(spark, sf_dir, D.SKIPS))


# Intervals


def island_sql(rows: str, gap: int, order: str = "start_ms, end_ms", keys: str = "video_id") -> str:
    w = f"(PARTITION BY {keys} ORDER BY {order}"
    return f"""SELECT *, sum(opens) OVER {w} ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start_ms <= max(end_ms) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS opens FROM ({rows}) i0) i1"""


@query(f"SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, 'sponsorblock' AS source, 'community' AS confidence, '' AS reason, true AS auto_skip FROM ({island_sql(COMMUNITY_MS, 1000)}) i GROUP BY video_id, island")
def m1_normalize_segments(spark, sf_dir):
    return I.normalize_segments(community(spark, sf_dir), "sponsorblock").drop("model")


@query(
    f"""SELECT video_id, start_ms, end_ms, CASE WHEN top = 2 THEN 'high' ELSE 'medium' END AS confidence, category FROM (
    SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(CASE confidence WHEN 'high' THEN 2 ELSE 1 END) AS top,
           CASE WHEN min(category) = max(category) THEN min(category) ELSE 'paid-sponsor' END AS category
    FROM ({island_sql(f"SELECT * FROM {ANS} a", 1000, "start_ms, end_ms, category, reason")}) i GROUP BY video_id, island) m"""
)
def m2_merge_answers(spark, sf_dir):
    return I.merge_answers(sample(spark, sf_dir, D.ANSWERS)).drop("reason")


@query(
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, confidence, category, reason) AS k FROM {LOC} l),
    f AS (SELECT video_id, k, start_ms, end_ms, 1 AS grp FROM r WHERE k = 1
      UNION ALL SELECT r.video_id, r.k, CASE WHEN ok THEN f.start_ms ELSE r.start_ms END, CASE WHEN ok THEN greatest(f.end_ms, r.end_ms) ELSE r.end_ms END, CASE WHEN ok THEN f.grp ELSE f.grp + 1 END
      FROM f JOIN r ON r.video_id = f.video_id AND r.k = f.k + 1,
      LATERAL (SELECT r.start_ms - f.end_ms <= 8000 AND greatest(f.end_ms, r.end_ms) - least(f.start_ms, r.start_ms) <= 180000 AS ok) o)
    SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM f GROUP BY video_id, grp"""
)
def m3_merge_local(spark, sf_dir):
    rows = sample(spark, sf_dir, D.LOCAL).withColumns({"score": F.lit(1), "groups": F.array(F.lit("url")), "brands": F.array(F.concat(F.lit("b"), F.col("event_idx").cast("string")))})
    return I.merge_local(rows).select("video_id", "start_ms", "end_ms")


@query(f"SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM ({island_sql(f'SELECT video_id, start_ms - 60000 AS start_ms, end_ms + 60000 AS end_ms FROM {LOC} l', 0)}) i GROUP BY video_id, island")
def m6_merge_ranges(spark, sf_dir):
    return I.merge_ranges(sample(spark, sf_dir, D.LOCAL), F.lit(60000.0))


def covered_sql(runs: str) -> str:
    return f"SELECT video_id, sum(ms) AS covered_ms FROM (SELECT video_id, max(end_ms) - min(start_ms) AS ms FROM ({runs}) i GROUP BY video_id, island) c GROUP BY video_id"



@query(covered_sql(island_sql(f"SELECT video_id, start_ms, end_ms FROM {LOC} l", 0)))
def a1_coverage(spark, sf_dir):
    return I.coverage(sample(spark, sf_dir, D.LOCAL))


PAIRS = f"SELECT p.video_id, greatest(p.start_ms, t.start_ms) AS start_ms, least(p.end_ms, t.end_ms) AS end_ms FROM {LOC} p JOIN {TRUE_} t ON t.video_id = p.video_id AND least(p.end_ms, t.end_ms) > greatest(p.start_ms, t.start_ms)"


@query(PAIRS)
def j6_overlap_pairs(spark, sf_dir):
    return I.overlap_pairs(sample(spark, sf_dir, D.LOCAL), sample(spark, sf_dir, D.TRUTH))


@query(covered_sql(island_sql(PAIRS, 0)))
def a2_overlap(spark, sf_dir):
    return I.coverage(j6_overlap_pairs(spark, sf_dir))


BEST = f"""SELECT video_id, truth_id, CASE WHEN iou > 0 THEN iou END AS iou, CASE WHEN iou > 0 THEN abs(ps - ts) END AS start_error, CASE WHEN iou > 0 THEN abs(pe - te) END AS end_error FROM (
    SELECT t.video_id, t.event_idx AS truth_id, t.start_ms AS ts, t.end_ms AS te, p.start_ms AS ps, p.end_ms AS pe,
           coalesce(greatest(0, least(t.end_ms, p.end_ms) - greatest(t.start_ms, p.start_ms)) / (greatest(t.end_ms, p.end_ms) - least(t.start_ms, p.start_ms)), 0) AS iou
    FROM {TRUE_} t LEFT JOIN {LOC} p ON p.video_id = t.video_id) b
    QUALIFY row_number() OVER (PARTITION BY video_id, truth_id, ts, te ORDER BY iou DESC, ps, pe) = 1"""


@query(BEST)
def j7_best_match(spark, sf_dir):
    return I.best_match(sample(spark, sf_dir, D.TRUTH).withColumnRenamed("event_idx", "truth_id"), sample(spark, sf_dir, D.LOCAL))


@query(
    f"""SELECT video_id, start_ms + CASE WHEN b IS NULL OR start_ms - b > 10000 THEN 3000 ELSE 0 END AS start_ms, end_ms - CASE WHEN a IS NULL OR a - end_ms > 10000 THEN 3000 ELSE 0 END AS end_ms FROM (
    SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) AS b, lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) AS a FROM ({SQL["m1_normalize_segments"]}) m) x
    WHERE end_ms - CASE WHEN a IS NULL OR a - end_ms > 10000 THEN 3000 ELSE 0 END > start_ms + CASE WHEN b IS NULL OR start_ms - b > 10000 THEN 3000 ELSE 0 END"""
)
def w5_trim_segments(spark, sf_dir):
    return I.trim_segments(m1_normalize_segments(spark, sf_dir)).select("video_id", "start_ms", "end_ms")


MATCH = """least(c.end_ms, a.end_ms) > greatest(c.start_ms, a.start_ms) AND (a.start_ms <= c.start_ms + (c.end_ms - c.start_ms) / 2 AND a.end_ms >= c.start_ms + (c.end_ms - c.start_ms) / 2
    OR least(c.end_ms, a.end_ms) - greatest(c.start_ms, a.start_ms) >= least(5000, (c.end_ms - c.start_ms) / 2))"""


@query(f"SELECT c.video_id, c.start_ms, c.end_ms, a.start_ms AS a_start, a.end_ms AS a_end FROM {LOC} c JOIN {ANS} a ON a.video_id = c.video_id AND {MATCH}")
def j2_match_candidates(spark, sf_dir):
    return I.match_candidates(sample(spark, sf_dir, D.LOCAL), sample(spark, sf_dir, D.ANSWERS))


SECONDS = f"SELECT video_id, start_ms / 1000 AS start_s, end_ms / 1000 AS end_s, concat(CAST(floor(start_ms / 100 + 0.5) AS BIGINT), ':', CAST(floor(end_ms / 100 + 0.5) AS BIGINT)) AS seg_key, event_idx FROM {LOC} l"


@query(
    f"""WITH s AS ({SECONDS}), u AS (SELECT video_id, start_s + 3 AS start_s, start_s + 9 AS end_s FROM s WHERE event_idx % 3 = 0)
    SELECT video_id, start_s, end_s, seg_key FROM s WHERE event_idx % 5 <> 1
      AND NOT EXISTS (SELECT 1 FROM u WHERE u.video_id = s.video_id AND least(u.end_s, s.end_s) - greatest(u.start_s, s.start_s) > 0.25)
      AND NOT EXISTS (SELECT 1 FROM s k WHERE k.event_idx % 5 = 1 AND k.video_id = s.video_id AND k.seg_key = s.seg_key)"""
)
def j3_suppress_undone(spark, sf_dir):
    ms = sample(spark, sf_dir, D.LOCAL)
    s = ms.select("video_id", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "event_idx").withColumn("key", T.segment_key(F.col("start_s"), F.col("end_s")))
    undone = s.filter("event_idx % 3 = 0").select("video_id", (F.col("start_s") + 3).alias("start_s"), (F.col("start_s") + 9).alias("end_s"))
    return I.suppress_undone(s, undone, s.filter("event_idx % 5 = 1")).select("video_id", "start_s", "end_s", F.col("key").alias("seg_key"))


@query(
    f"""WITH s AS ({SECONDS}), p AS ({D.POSITIONS}),
    i AS (SELECT p.*, first(s.end_s ORDER BY s.start_s, s.end_s) FILTER (p.pos_s >= s.start_s AND p.pos_s < s.end_s) AS skip_to, min(s.start_s) FILTER (s.start_s > p.pos_s AND s.start_s <= p.pos_s + 15) AS ahead
          FROM p LEFT JOIN s USING (video_id) GROUP BY ALL)
    SELECT video_id, event_id, pos_s, skip_to, CASE WHEN skip_to IS NULL THEN ahead END AS next_start FROM i"""
)
def j4_label_positions(spark, sf_dir):
    segs = sample(spark, sf_dir, D.LOCAL).select("video_id", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))
    return I.label_positions(sample(spark, sf_dir, D.POSITIONS), segs)


# Topics

TOKENS = f"""SELECT video_id, event_idx, start_ms, end_ms, token, count(*) AS n FROM (SELECT video_id, event_idx, start_ms, end_ms, unnest(regexp_extract_all({NORM}, '{P.TOKEN}')) AS token FROM {CAP} c) t
    WHERE token NOT IN ({", ".join(f"'{w}'" for w in dict.fromkeys([*P.STOP_WORDS, *P.COMMERCIAL_WORDS]))}) GROUP BY ALL"""
IDF = f"""SELECT video_id, token, count(*) AS df, ln(((SELECT count(*) FROM events e WHERE e.user_id = t.video_id) + 1) / (count(*) + 1)) + 1 AS idf FROM ({TOKENS}) t GROUP BY video_id, token"""
BEFORE = f"SELECT video_id, event_idx AS window_id, greatest(0, start_ms - 30000) AS from_ms, greatest(0, start_ms - 1) AS to_ms FROM {CAP} c WHERE phase = 8"
AFTER = f"SELECT video_id, event_idx AS window_id, greatest(0, start_ms + 48000) AS from_ms, start_ms + 96000 AS to_ms FROM {CAP} c WHERE phase = 8"


def vectors_sql(windows: str) -> str:
    return f"""SELECT w.video_id, w.window_id, t.token, (1 + ln(sum(t.n))) * any_value(i.idf) AS weight FROM ({windows}) w JOIN tok t ON t.video_id = w.video_id AND t.end_ms >= w.from_ms AND t.start_ms <= w.to_ms
      JOIN idf i ON i.video_id = t.video_id AND i.token = t.token GROUP BY ALL"""


def topic_windows(spark, sf_dir, back, to):
    return captions(spark, sf_dir).filter("phase = 8").select("video_id", F.col("event_idx").alias("window_id"), F.greatest(F.lit(0.0), F.col("start_ms") - back).alias("from_ms"), to.alias("to_ms"))


def topics_before(spark, sf_dir):
    from .operators.topics import topic_vectors

    return topic_vectors(topic_windows(spark, sf_dir, 30000, F.greatest(F.lit(0.0), F.col("start_ms") - 1)), captions(spark, sf_dir))


@query(IDF)
def a5_document_frequency(spark, sf_dir):
    from .operators.topics import document_frequency

    return document_frequency(captions(spark, sf_dir))


@query(f"WITH tok AS ({TOKENS}), idf AS ({IDF}) {vectors_sql(BEFORE)}")
def a6_topic_vectors(spark, sf_dir):
    return topics_before(spark, sf_dir)


@query(
    f"""WITH tok AS ({TOKENS}), idf AS ({IDF}), a AS ({vectors_sql(BEFORE)}), b AS ({vectors_sql(AFTER)}),
    k AS (SELECT DISTINCT video_id, window_id FROM a INTERSECT SELECT DISTINCT video_id, window_id FROM b),
    u AS (SELECT video_id, window_id, token, sum(x) AS x, sum(y) AS y FROM (SELECT video_id, window_id, token, weight AS x, 0 AS y FROM a UNION ALL SELECT video_id, window_id, token, 0, weight FROM b) z GROUP BY ALL),
    s AS (SELECT video_id, window_id, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cosine, sum(least(x, y)) / sum(greatest(x, y)) AS jaccard, count(*) FILTER (x > 0 AND y > 0) AS shared FROM u JOIN k USING (video_id, window_id) GROUP BY ALL)
    SELECT *, shared >= 2 AND cosine >= 0.24 AND jaccard >= 0.16 AS returned FROM s"""
)
def a7_topic_similarity(spark, sf_dir):
    from .operators.topics import topic_similarity, topic_vectors

    after = topic_vectors(topic_windows(spark, sf_dir, -48000, F.col("start_ms") + 96000), captions(spark, sf_dir))
    return topic_similarity(topics_before(spark, sf_dir), after)


@query(
    f"""SELECT brand, category, confidence, count(*) AS segments, sum(end_ms - start_ms) / 1000 AS seconds FROM (
    SELECT *, CASE video_id % 5 WHEN 0 THEN 'acme' WHEN 1 THEN 'zenly' WHEN 2 THEN 'orbit' WHEN 3 THEN 'kudos' ELSE 'nimbus' END AS brand FROM {LOC} l) b GROUP BY ALL"""
)
def a9_brand_summary(spark, sf_dir):
    brand = F.element_at(F.array(*map(F.lit, ("acme", "zenly", "orbit", "kudos", "nimbus"))), (F.col("video_id") % 5 + 1).cast("int"))
    rows = sample(spark, sf_dir, D.LOCAL).withColumn("brands", F.array(brand)).withColumn("brand", F.explode("brands"))
    return rows.groupBy("brand", "category", "confidence").agg(F.count("*").alias("segments"), (F.sum(F.col("end_ms") - F.col("start_ms")) / 1000).alias("seconds"))


# Evaluation


def videos(spark, sf_dir):
    return captions(spark, sf_dir).groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))


def truth(spark, sf_dir):
    return sample(spark, sf_dir, D.TRUTH).withColumnRenamed("event_idx", "truth_id")


@query(f"SELECT median(start_error) AS median_start_error, median(end_error) AS median_end_error, avg(iou) AS mean_iou FROM ({BEST}) b")
def a3_boundary_errors(spark, sf_dir):
    from .jobs.evaluate import boundary_errors

    return boundary_errors(j7_best_match(spark, sf_dir))


def _covered(rows: str) -> str:
    return f"(SELECT sum(covered_ms) FROM ({covered_sql(island_sql(rows, 0))}) z)"


_P, _T = f"SELECT video_id, start_ms, end_ms, category FROM {LOC} l", f"SELECT video_id, start_ms, end_ms, category FROM {TRUE_} t"
_OWN = f"SELECT * FROM ({_T}) o WHERE category = 'self-promotion'"
_WRONG = f"SELECT p.video_id, greatest(p.start_ms, o.start_ms) AS start_ms, least(p.end_ms, o.end_ms) AS end_ms FROM ({_P}) p JOIN ({_OWN}) o ON o.video_id = p.video_id AND p.category <> 'self-promotion' AND least(p.end_ms, o.end_ms) > greatest(p.start_ms, o.start_ms)"


@query(
    f"""WITH b AS ({BEST}), s AS (SELECT {_covered(_P)} AS p, {_covered(_T)} AS t, {_covered(PAIRS)} AS o, {_covered(_OWN)} AS own, coalesce({_covered(_WRONG)}, 0) AS wrong,
      (SELECT sum(d) FROM (SELECT max(end_ms) AS d FROM {CAP} c GROUP BY video_id) v) AS d, (SELECT count(DISTINCT user_id) FROM events) AS videos)
    SELECT o / p AS precision, o / t AS recall, greatest(0, p - o) / 1000 / (d / 3600000) AS false_seconds_per_hour, median(start_error) AS median_start_error, median(end_error) AS median_end_error, avg(iou) AS mean_iou,
           count(iou) / count(*) AS segment_recall, wrong / own AS self_promotion_confusion, videos, count(*) AS truth_segments, count(iou) AS detected_segments FROM b, s GROUP BY p, t, o, own, wrong, d, videos"""
)
def a4_evaluate(spark, sf_dir):
    from .jobs.evaluate import evaluate

    return evaluate(sample(spark, sf_dir, D.LOCAL), truth(spark, sf_dir), videos(spark, sf_dir))


def m5_detect_segments(spark, sf_dir):
    """Sequential per video, so without SQL; the tests hold golden cases."""
    from .jobs.detect import detect_segments

    return detect_segments(captions(spark, sf_dir).select("video_id", "start_ms", "end_ms", "text"))


QUERIES["m5_detect_segments"] = m5_detect_segments


# Routing

OWNED = "(SELECT video_id, handle FROM (SELECT DISTINCT user_id AS video_id FROM events) v JOIN " + HANDLES + " h ON h.c_custkey = v.video_id)"


def owned(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("video_id")).distinct()
    return e.join(handles(spark, sf_dir).withColumnRenamed("c_custkey", "video_id"), "video_id")


def blocked(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 = 0").select(F.concat(F.lit(" "), F.upper("c_name")).alias("handle"))


@query(
    f"""SELECT video_id FROM {OWNED} o WHERE trim(handle) = '' OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 0 AND lower(trim(o.handle, ' @')) = lower(c_name))"""
)
def j1_drop_blocked(spark, sf_dir):
    from .operators.routing import drop_blocked

    return drop_blocked(owned(spark, sf_dir), blocked(spark, sf_dir)).select("video_id")


MODES = "(SELECT DISTINCT user_id AS video_id, CASE user_id % 4 WHEN 0 THEN 'local-only' WHEN 1 THEN 'sponsorblock-only' ELSE 'local-fallback' END AS mode FROM events)"
FEW = f"(SELECT * FROM {LOC} l WHERE video_id % 5 > 1)"
HIT = f"(mode <> 'local-only' AND video_id IN (SELECT video_id FROM ({COMMUNITY_MS}) c))"


def moded(spark, sf_dir):
    k = F.col("video_id") % 4
    return videos(spark, sf_dir).select("video_id", F.when(k == 0, "local-only").when(k == 1, "sponsorblock-only").otherwise("local-fallback").alias("mode"))


@query(
    f"""SELECT video_id, CASE WHEN {HIT} THEN 'community' WHEN mode <> 'sponsorblock-only' AND video_id IN (SELECT video_id FROM {FEW} l) THEN mode
      WHEN video_id IN (SELECT video_id FROM {ANS} a) THEN 'llm-fallback' ELSE 'none' END AS route FROM {MODES} m"""
)
def j8_route_sources(spark, sf_dir):
    from .operators.routing import route_sources

    return route_sources(moded(spark, sf_dir), community(spark, sf_dir), sample(spark, sf_dir, D.LOCAL).filter("video_id % 5 > 1"), sample(spark, sf_dir, D.ANSWERS))


SURE = f"(SELECT video_id, event_idx, start_ms, end_ms, CASE WHEN video_id % 2 = 0 THEN 'high' ELSE confidence END AS confidence FROM {LOC} l)"


def sure(spark, sf_dir):
    return sample(spark, sf_dir, D.LOCAL).withColumn("confidence", F.when(F.col("video_id") % 2 == 0, "high").otherwise(F.col("confidence")))


@query(f"SELECT video_id, event_idx, start_ms, end_ms FROM {SURE} s WHERE end_ms - start_ms > 25000 AND video_id NOT IN (SELECT video_id FROM {SURE} u WHERE confidence <> 'high')")
def m7_deliverable(spark, sf_dir):
    from .operators.routing import deliverable

    return deliverable(sure(spark, sf_dir)).select("video_id", "event_idx", "start_ms", "end_ms")


#: Segments of the local detector where it is asked, with what each needs: 2 unsure, 1 short, 0 nothing.
RANKED = f"(SELECT s.*, CASE WHEN confidence <> 'high' THEN 2 WHEN end_ms - start_ms <= 25000 THEN 1 ELSE 0 END AS r FROM {SURE} s JOIN {MODES} m USING (video_id) WHERE mode <> 'sponsorblock-only')"
PLAN = f"""SELECT v.video_id, CASE top WHEN 2 THEN 'candidate-verification' WHEN 1 THEN 'short-verification' ELSE 'fallback' END AS kind, s.start_ms, s.end_ms,
      CASE top WHEN 2 THEN least(240000, greatest(90000, 2 * (s.end_ms - s.start_ms))) WHEN 1 THEN 60000 END AS context_ms
    FROM {MODES} v LEFT JOIN (SELECT video_id, max(r) AS top FROM {RANKED} b GROUP BY video_id) t USING (video_id)
    LEFT JOIN {RANKED} s ON s.video_id = v.video_id AND s.r = t.top WHERE NOT {HIT.replace("video_id IN", "v.video_id IN")} AND (top IS NULL OR top > 0)"""


def plan(spark, sf_dir):
    from .operators.routing import llm_plan

    return llm_plan(moded(spark, sf_dir), sure(spark, sf_dir), community(spark, sf_dir))


@query(PLAN)
def l1_llm_plan(spark, sf_dir):
    return plan(spark, sf_dir).drop("confidence")


@query(
    f"""WITH p AS ({PLAN}), k AS (SELECT DISTINCT video_id, kind FROM p)
    SELECT c.video_id, c.start_ms, c.end_ms, 'local' AS origin FROM {SURE} c JOIN k USING (video_id) WHERE kind <> 'fallback'
      AND NOT EXISTS (SELECT 1 FROM p WHERE p.video_id = c.video_id AND p.start_ms = c.start_ms AND p.end_ms = c.end_ms)
      AND NOT (kind = 'candidate-verification' AND EXISTS (SELECT 1 FROM {ANS} a WHERE a.video_id = c.video_id AND {MATCH}))
    UNION ALL SELECT a.video_id, a.start_ms, a.end_ms, 'llm' FROM {ANS} a WHERE a.video_id IN (SELECT video_id FROM k)"""
)
def m8_combine_verified(spark, sf_dir):
    from .operators.routing import combine_verified

    rows = {"sure": sure(spark, sf_dir), "answers": sample(spark, sf_dir, D.ANSWERS), "plan": plan(spark, sf_dir)}
    return combine_verified(*(settled(df, k) for k, df in rows.items()))


FAILED = "(SELECT DISTINCT user_id AS video_id FROM events WHERE user_id % 11 = 3)"


@query(
    f"""WITH m AS (SELECT * FROM {MODES} x), p AS ({PLAN}), k AS (SELECT DISTINCT video_id, kind FROM p), lost AS (SELECT video_id FROM {FAILED} f),
    own AS (SELECT s.video_id, s.event_idx, s.start_ms, s.end_ms, s.confidence, m.mode FROM {SURE} s JOIN m USING (video_id) WHERE mode <> 'sponsorblock-only' AND NOT {HIT}),
    acc AS (SELECT a.* FROM {ANS} a JOIN k USING (video_id) WHERE video_id NOT IN (SELECT video_id FROM lost)
            AND (kind = 'fallback' OR EXISTS (SELECT 1 FROM p c WHERE c.video_id = a.video_id AND {MATCH}))),
    llm AS (SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM ({island_sql("SELECT video_id, start_ms, end_ms FROM acc", 1000)}) i GROUP BY video_id, island),
    left_ AS (SELECT o.* FROM own o JOIN k USING (video_id) WHERE video_id NOT IN (SELECT video_id FROM lost) AND kind <> 'fallback'
              AND NOT EXISTS (SELECT 1 FROM p WHERE p.video_id = o.video_id AND p.start_ms = o.start_ms AND p.end_ms = o.end_ms)
              AND NOT (kind = 'candidate-verification' AND EXISTS (SELECT 1 FROM llm a, (SELECT o.start_ms, o.end_ms) c WHERE a.video_id = o.video_id AND {MATCH}))),
    spoken AS (SELECT video_id FROM llm UNION SELECT video_id FROM left_ JOIN k USING (video_id) WHERE kind = 'candidate-verification'),
    out AS (SELECT video_id, start_ms, end_ms, 'llm-fallback' AS source FROM left_ WHERE video_id IN (SELECT video_id FROM spoken)
      UNION ALL SELECT video_id, start_ms, end_ms, 'llm-fallback' FROM llm
      UNION ALL SELECT video_id, start_ms, end_ms, mode FROM own WHERE confidence = 'high' AND video_id IN (SELECT video_id FROM k) AND video_id IN (SELECT video_id FROM lost)
      UNION ALL SELECT o.video_id, start_ms, end_ms, mode FROM own o JOIN k USING (video_id) WHERE kind = 'short-verification' AND end_ms - start_ms > 25000 AND video_id NOT IN (SELECT video_id FROM lost) AND video_id NOT IN (SELECT video_id FROM spoken)
      UNION ALL SELECT video_id, start_ms, end_ms, mode FROM own WHERE video_id NOT IN (SELECT video_id FROM k))
    SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(source) AS source FROM ({island_sql("SELECT * FROM out", 1000)}) i GROUP BY video_id, island
    UNION ALL SELECT video_id, min(start_ms), max(end_ms), 'sponsorblock' FROM ({island_sql(f"SELECT * FROM ({COMMUNITY_MS}) z WHERE video_id IN (SELECT video_id FROM {MODES} q WHERE {HIT})", 1000)}) i GROUP BY video_id, island"""
)
def b1_deliver(spark, sf_dir):
    """Workload B as a whole: what each video's viewers get, by mode, hit, plan, answers and failures."""
    from .operators.routing import deliver

    made = {"modes": moded(spark, sf_dir), "theirs": community(spark, sf_dir), "sure": sure(spark, sf_dir), "answers": sample(spark, sf_dir, D.ANSWERS)}
    rows = {k: settled(df, k) for k, df in made.items()}
    lost = rows["modes"].select("video_id").filter("video_id % 11 = 3")
    return deliver(rows["modes"], rows["theirs"], rows["sure"], rows["answers"], lost).select("video_id", "start_ms", "end_ms", "source")


#: As MODES, without the videos of blocked channels; the model is off for every fifth video.
_OPEN = f"(SELECT * FROM {MODES} o1 WHERE video_id NOT IN (SELECT video_id FROM {OWNED} o2 JOIN customer c ON c.c_custkey % 3 = 0 AND lower(trim(o2.handle, ' @')) = lower(c.c_name)))"


@query(
    f"""WITH d AS (SELECT *, lag(end_ms) OVER w AS before, lead(start_ms) OVER w AS after FROM (
      {SQL["b1_deliver"].replace(MODES, _OPEN).replace("WHERE NOT (mode", "WHERE v.video_id % 5 <> 0 AND NOT (mode")}) x WINDOW w AS (PARTITION BY video_id, source ORDER BY start_ms, end_ms)),
    t AS (SELECT video_id, source, start_ms + CASE WHEN source <> 'sponsorblock' OR before IS NULL OR start_ms - before > 10000 THEN 3000 ELSE 0 END AS start_ms,
      end_ms - CASE WHEN source <> 'sponsorblock' OR after IS NULL OR after - end_ms > 10000 THEN 3000 ELSE 0 END AS end_ms FROM d)
    SELECT video_id, start_ms, end_ms, source FROM t WHERE end_ms > start_ms"""
)
def b2_deliver_trimmed(spark, sf_dir):
    """As b1, with blocked channels, the model off for some videos, and trimmed edges."""
    from .operators.routing import deliver

    modes = moded(spark, sf_dir).withColumn("llm", F.col("video_id") % 5 != 0).join(owned(spark, sf_dir), "video_id", "left")
    made = {"modes": modes, "theirs": community(spark, sf_dir), "sure": sure(spark, sf_dir), "answers": sample(spark, sf_dir, D.ANSWERS)}
    rows = {k: settled(df, k) for k, df in made.items()}
    lost = rows["modes"].select("video_id").filter("video_id % 11 = 3")
    out = deliver(rows["modes"], rows["theirs"], rows["sure"], rows["answers"], lost, blocked(spark, sf_dir), (None, None))
    return out.select("video_id", "start_ms", "end_ms", "source")


# Requests and answers

LINES = f"SELECT video_id, event_idx, start_ms, end_ms, printf('[%d] %.3f-%.3f %s', event_idx, start_ms / 1000, end_ms / 1000, text) AS line FROM {CAP} c"


@query(f"SELECT video_id, event_idx, line FROM ({LINES}) l")
def l2_format_lines(spark, sf_dir):
    from .operators.requests import format_lines

    return format_lines(captions(spark, sf_dir)).select("video_id", "event_idx", "line")


_PAUSED = f"SELECT video_id, event_idx, start_ms, end_ms, printf('[%d] %.3f-%.3f %s', event_idx, start_ms / 1000, end_ms / 1000, text) AS line FROM ({D.PAUSED}) c"
_CHUNK_CHARS, _OVERLAP_MS = 1200, 24_000


#: For every caption where a chunk from it ends by size (stop), where it ends (b), and where the next one starts.
STEPS = f"""l AS (SELECT *, sum(length(line) + 1) OVER w AS upto, start_ms - lag(end_ms) OVER w >= 1200 AS pause, count(*) OVER (PARTITION BY video_id) AS n FROM ({_PAUSED}) x WINDOW w AS (PARTITION BY video_id ORDER BY event_idx)),
    most AS (SELECT a.video_id, a.event_idx AS a, a.n, greatest(a.event_idx, coalesce(max(b.event_idx) FILTER (b.upto - a.upto + length(a.line) + 1 <= {_CHUNK_CHARS}), 0)) + 1 AS stop
             FROM l a JOIN l b ON b.video_id = a.video_id AND b.event_idx >= a.event_idx GROUP BY a.video_id, a.event_idx, a.n),
    ended AS (SELECT m.video_id, a, m.n, m.stop, coalesce(max(p.event_idx), stop) AS b FROM most m
              LEFT JOIN l p ON p.video_id = m.video_id AND p.pause AND m.stop < m.n AND p.event_idx <= stop AND p.event_idx > a + greatest(1, CAST(floor((stop - a) * 0.75) AS INT)) GROUP BY m.video_id, a, m.n, stop),
    steps AS (SELECT e.video_id, e.a, e.b, e.n, e.stop, least(e.b, greatest(e.a + 1, coalesce(max(o.event_idx) + 1, 0))) AS next FROM ended e JOIN l z ON z.video_id = e.video_id AND z.event_idx = e.b - 1
              LEFT JOIN l o ON o.video_id = e.video_id AND o.event_idx < e.b AND o.end_ms <= z.end_ms - {_OVERLAP_MS} GROUP BY e.video_id, e.a, e.b, e.n, e.stop)"""


@query(
    f"""WITH RECURSIVE {STEPS},
    chunks AS (SELECT video_id, 0 AS chunk_id, a, b, n, next FROM steps WHERE a = 0
               UNION ALL SELECT s.video_id, chunk_id + 1, s.a, s.b, s.n, s.next FROM chunks k JOIN steps s ON s.video_id = k.video_id AND s.a = k.next WHERE k.b < k.n)
    SELECT k.video_id, CAST(chunk_id AS INT) AS chunk_id, CAST(a AS INT) AS start_idx, CAST(b AS INT) AS end_idx, string_agg(line, chr(10) ORDER BY event_idx) AS text
    FROM chunks k JOIN l ON l.video_id = k.video_id AND event_idx >= a AND event_idx < b GROUP BY k.video_id, chunk_id, a, b"""
)
def l3_chunk_events(spark, sf_dir):
    """Small chunks, so that every video has several; some captions have a pause before them."""
    from .operators.requests import chunk_events, format_lines

    return chunk_events(format_lines(sample(spark, sf_dir, D.PAUSED)), _CHUNK_CHARS, float(_OVERLAP_MS))


#: The jobs of the plan, and the captions that each looks at.
JOBS = f"SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) - 1 AS INT) AS job_id FROM ({PLAN}) p"
JOB_RANGES = f"""job AS ({JOBS}), n AS (SELECT video_id, CAST(count(*) AS INT) AS n FROM ({D.PAUSED}) c GROUP BY video_id),
    near AS (SELECT j.video_id, j.job_id, any_value(j.end_ms + context_ms) AS t, coalesce(min(c.event_idx) FILTER (c.end_ms >= j.start_ms - context_ms), max(c.event_idx)) AS a FROM job j JOIN ({D.PAUSED}) c ON c.video_id = j.video_id WHERE j.start_ms IS NOT NULL GROUP BY j.video_id, j.job_id),
    ranged AS (SELECT w.video_id, w.job_id, w.a, coalesce((SELECT min(event_idx) FROM ({D.PAUSED}) c WHERE c.video_id = w.video_id AND c.event_idx >= w.a AND c.start_ms > w.t), n.n) AS lim FROM near w JOIN n ON n.video_id = w.video_id
               UNION ALL SELECT j.video_id, j.job_id, 0, n.n FROM job j JOIN n ON n.video_id = j.video_id WHERE j.start_ms IS NULL)"""
JOB_CHUNKS = f"""{JOB_RANGES}, {STEPS},
    walked AS (SELECT r.video_id, r.job_id, 0 AS chunk_id, r.a, CASE WHEN s.stop >= r.lim THEN r.lim ELSE s.b END AS b, r.lim, s.stop, s.next FROM ranged r JOIN steps s ON s.video_id = r.video_id AND s.a = r.a
               UNION ALL SELECT k.video_id, k.job_id, k.chunk_id + 1, s.a, CASE WHEN s.stop >= k.lim THEN k.lim ELSE s.b END, k.lim, s.stop, s.next FROM walked k JOIN steps s ON s.video_id = k.video_id AND s.a = k.next WHERE k.stop < k.lim)"""


def jobs(spark, sf_dir):
    from .operators.routing import numbered_jobs

    return settled(numbered_jobs(plan(spark, sf_dir)), "jobs")


@query(f"WITH RECURSIVE {JOB_CHUNKS} SELECT video_id, job_id, CAST(chunk_id AS INT) AS chunk_id, CAST(a AS INT) AS start_idx, CAST(b AS INT) AS end_idx FROM walked")
def l3_job_chunks(spark, sf_dir):
    """The chunks of every verification job: of the captions around its candidates, or of the whole video."""
    from .operators.requests import format_lines, job_chunks, job_ranges

    events = settled(sample(spark, sf_dir, D.PAUSED), "events")
    found = job_chunks(format_lines(events), job_ranges(jobs(spark, sf_dir), events), _CHUNK_CHARS, float(_OVERLAP_MS))
    return found.select("video_id", "job_id", "chunk_id", "start_idx", "end_idx")


def model_stub(requests: DataFrame, fails: str = "false") -> DataFrame:
    """A stand-in for a language model: four captions from each sponsor's name on, one from each merch alert; errors where `fails` holds."""
    lines = F.split(F.substring_index(F.get_json_object("request", "$.messages[1].content"), "Captions:\n", -1), "\n")
    wanted = F.filter(lines, lambda x: x.rlike("sponsored by|I want to thank|Merch alert"))
    number = lambda x: F.regexp_extract(x, r"^\[(\d+)\]", 1).cast("int")
    merch = lambda x: x.contains("Merch alert")
    item = lambda x: F.struct(number(x).alias("start_event"), (number(x) + F.when(merch(x), 1).otherwise(4)).alias("end_event"), F.when(number(x) % 2 == 0, "high").otherwise("medium").alias("confidence"), F.when(merch(x), "self_promo").otherwise("sponsor").alias("category"), F.lit("said so").alias("reason"))
    text = F.to_json(F.struct(F.transform(wanted, item).alias("segments")))
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    broken = F.expr(fails)
    return requests.select("request_key", F.when(~broken, payload).alias("payload"), F.when(broken, "busy").alias("error"))


def _said(chunks: str) -> str:
    return f"""SELECT k.video_id, k.job_id, k.chunk_id, k.a, k.b, x.start_ms, coalesce(e.start_ms, z.end_ms) AS end_ms, CASE WHEN x.event_idx % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, CASE x.w WHEN 1 THEN 'self-promotion' ELSE 'paid-sponsor' END AS category
      FROM {chunks} k JOIN (SELECT *, CASE WHEN text LIKE '%Merch alert%' THEN 1 ELSE 4 END AS w FROM ({D.PAUSED}) c WHERE regexp_matches(text, 'sponsored by|I want to thank|Merch alert')) x ON x.video_id = k.video_id AND x.event_idx >= k.a AND x.event_idx + x.w <= k.b
      LEFT JOIN ({D.PAUSED}) e ON e.video_id = k.video_id AND e.event_idx = x.event_idx + x.w JOIN (SELECT video_id, max_by(end_ms, event_idx) AS end_ms FROM ({D.PAUSED}) c GROUP BY video_id) z ON z.video_id = k.video_id
      WHERE coalesce(e.start_ms, z.end_ms) > x.start_ms"""


_PC = f"({D.PAUSED})"
#: Both rounds of verification with the stub: answers (u) by job, not merged yet.
VERIFIED = f"""{JOB_CHUNKS}, said AS MATERIALIZED ({_said("walked")}),
    timed AS (SELECT s.*, f.start_ms AS from_ms, t.end_ms AS to_ms, n.n AS captions FROM said s JOIN n ON n.video_id = s.video_id JOIN {_PC} f ON f.video_id = s.video_id AND f.event_idx = s.a JOIN {_PC} t ON t.video_id = s.video_id AND t.event_idx = s.b - 1),
    edge AS (SELECT video_id, job_id, chunk_id, start_ms, end_ms, from_ms AS center_ms FROM timed WHERE a > 0 AND start_ms <= from_ms + 30000
             UNION ALL SELECT video_id, job_id, chunk_id, start_ms, end_ms, to_ms FROM timed WHERE b < captions AND end_ms >= to_ms - 30000),
    seam AS (SELECT video_id, job_id, seam, avg(center_ms) AS center_ms FROM (SELECT *, sum(o) OVER (PARTITION BY video_id, job_id ORDER BY center_ms, r) AS seam FROM (
      SELECT *, row_number() OVER w AS r, CASE WHEN center_ms - lag(center_ms) OVER w <= 120000 THEN 0 ELSE 1 END AS o FROM edge WINDOW w AS (PARTITION BY video_id, job_id ORDER BY center_ms)) f) g GROUP BY video_id, job_id, seam),
    again AS (SELECT *, coalesce((SELECT min(event_idx) FROM {_PC} c WHERE c.video_id = q.video_id AND c.event_idx >= q.a AND c.start_ms > q.center_ms + 120000), captions) AS b FROM (
      SELECT s.video_id, s.job_id, s.seam AS chunk_id, s.center_ms, max(c.event_idx) + 1 AS captions, coalesce(min(c.event_idx) FILTER (c.end_ms >= s.center_ms - 120000), max(c.event_idx)) AS a FROM seam s JOIN {_PC} c ON c.video_id = s.video_id GROUP BY s.video_id, s.job_id, s.seam, s.center_ms) q),
    u AS (SELECT video_id, job_id, start_ms, end_ms, confidence, category FROM said s WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.video_id = s.video_id AND e.job_id = s.job_id AND e.chunk_id = s.chunk_id AND e.start_ms = s.start_ms AND e.end_ms = s.end_ms)
      UNION ALL SELECT video_id, job_id, start_ms, end_ms, confidence, category FROM ({_said("again")}) r)"""


@query(
    f"""WITH RECURSIVE {VERIFIED}
    SELECT video_id, job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN min(category) = max(category) THEN min(category) ELSE 'paid-sponsor' END AS category
    FROM ({island_sql("SELECT * FROM u", 1000, keys="video_id, job_id")}) i GROUP BY video_id, job_id, island"""
)
def l12_verify(spark, sf_dir):
    """From the plan to merged answers in two rounds; the model fails for a third of all requests at first, and a second run goes on."""
    from .jobs.verify import ledger, verify

    asked, events = jobs(spark, sf_dir), settled(sample(spark, sf_dir, D.PAUSED), "events")
    kept = ledger(spark, shared_path(spark, "ledger"))
    verify(asked, events, lambda r: model_stub(r, "request_key < '5' and request_key > '05'").filter("request_key not like '4%'"), kept, "model", _CHUNK_CHARS, float(_OVERLAP_MS))
    found = verify(asked, events, model_stub, kept, "model", _CHUNK_CHARS, float(_OVERLAP_MS))
    return found.answers.drop("reason")


#: Chunks of 20 captions that overlap by five, for the queries with SQL.
CHUNKS = f"SELECT video_id, CAST(k AS INT) AS chunk_id, CAST(k * 15 AS INT) AS start_idx, CAST(least(k * 15 + 20, n) AS INT) AS end_idx FROM (SELECT video_id, count(*) AS n FROM {CAP} c GROUP BY video_id) v, range(0, (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id) m)) r(k) WHERE k = 0 OR k * 15 + 5 < n"


def chunks(spark, sf_dir):
    n = captions(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - 5) / 15) - 1).cast("int")
    k = n.select("video_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return k.select("video_id", F.col("k").alias("chunk_id"), (F.col("k") * 15).alias("start_idx"), F.least(F.col("k") * 15 + 20, F.col("n")).cast("int").alias("end_idx"))


RANGES = f"SELECT video_id, event_idx AS range_id, start_ms - 60000 AS start_ms, end_ms + 60000 AS end_ms FROM {LOC} l"


@query(
    f"""WITH c AS (SELECT * FROM {CAP} x), a AS (SELECT r.*, coalesce(min(c.event_idx) FILTER (c.end_ms >= r.start_ms), max(c.event_idx)) AS a, max(c.event_idx) AS z FROM ({RANGES}) r JOIN c ON c.video_id = r.video_id GROUP BY ALL)
    SELECT a.video_id, range_id, a AS start_idx, CAST(coalesce((SELECT min(event_idx) FROM c WHERE c.video_id = a.video_id AND c.event_idx >= a.a AND c.start_ms > a.end_ms), z + 1) AS INT) AS end_idx FROM a"""
)
def l4_focused_ranges(spark, sf_dir):
    from .operators.requests import focused_ranges

    r = sample(spark, sf_dir, D.LOCAL).select("video_id", F.col("event_idx").alias("range_id"), (F.col("start_ms") - 60000).alias("start_ms"), (F.col("end_ms") + 60000).alias("end_ms"))
    return focused_ranges(captions(spark, sf_dir), r)


TIMES = f"SELECT k.*, a.start_ms AS from_ms, b.end_ms AS to_ms, (SELECT count(*) FROM events e WHERE e.user_id = k.video_id) AS n FROM ({CHUNKS}) k JOIN {CAP} a ON a.video_id = k.video_id AND a.event_idx = k.start_idx JOIN {CAP} b ON b.video_id = k.video_id AND b.event_idx = k.end_idx - 1"
HINTS = f"""SELECT k.video_id, k.chunk_id, string_agg(printf('- %.3f-%.3f seconds (%s local confidence)', l.start_ms / 1000, l.end_ms / 1000, l.confidence), chr(10) ORDER BY l.start_ms, l.end_ms, l.confidence) AS hints
    FROM ({TIMES}) k JOIN {LOC} l ON l.video_id = k.video_id AND l.start_ms <= k.to_ms AND l.end_ms >= k.from_ms GROUP BY k.video_id, k.chunk_id"""


def hints(spark, sf_dir):
    from .operators.requests import candidate_hints

    return candidate_hints(chunks(spark, sf_dir), captions(spark, sf_dir), sample(spark, sf_dir, D.LOCAL))


@query(HINTS)
def j5_candidate_hints(spark, sf_dir):
    return hints(spark, sf_dir)


@query(
    f"""SELECT k.video_id, k.chunk_id, h.hints IS NOT NULL AS hinted, string_agg(l.line, chr(10) ORDER BY l.event_idx) AS lines FROM ({CHUNKS}) k JOIN ({LINES}) l ON l.video_id = k.video_id AND l.event_idx >= k.start_idx AND l.event_idx < k.end_idx
    LEFT JOIN ({HINTS}) h ON h.video_id = k.video_id AND h.chunk_id = k.chunk_id GROUP BY ALL"""
)
def l5_llm_requests(spark, sf_dir):
    """The requests, read back: the captions, and whether hints stand before them."""
    from .operators.requests import chunk_lines, format_lines, llm_requests

    texts = chunk_lines(chunks(spark, sf_dir), format_lines(captions(spark, sf_dir)))
    user = F.get_json_object("request", "$.messages[1].content")
    return llm_requests(texts, hints(spark, sf_dir), "model").select("video_id", "chunk_id", user.startswith("Candidates:").alias("hinted"), F.substring_index(user, "Captions:\n", -1).alias("lines"))


def responses(spark, sf_dir):
    """One answer per chunk from the truth inside it; by video whole, fenced, out of range or not JSON."""
    t = truth(spark, sf_dir).select(F.col("video_id").alias("v"), F.col("truth_id").alias("a"), "category")
    c = chunks(spark, sf_dir)
    met = c.join(t, (c.video_id == t.v) & (t.a >= c.start_idx) & (t.a + 4 <= c.end_idx), "left")
    shift = F.when(F.col("video_id") % 4 == 2, 1000).otherwise(0)
    item = F.struct((F.col("a") + shift).alias("start_event"), (F.col("a") + 4 + shift).alias("end_event"), F.lit("HIGH").alias("confidence"), F.regexp_replace(F.regexp_replace("category", "paid-", ""), "-promotion", "_promo").alias("category"), F.lit(" some \n evidence ").alias("reason"))
    found = met.groupBy("video_id", "chunk_id").agg(F.sort_array(F.collect_list(F.when(F.col("a").isNotNull(), item))).alias("segments"))
    text = F.to_json(F.struct("segments"))
    text = F.when(F.col("video_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```"))).when(F.col("video_id") % 4 == 3, "no idea {").otherwise(text)
    return found.select("video_id", "chunk_id", F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))).alias("payload"))


PARSED = f"""SELECT k.video_id, k.chunk_id, t.start_ms, coalesce(e.start_ms, m.end_ms) AS end_ms, 'high' AS confidence, t.category, 'some evidence' AS reason FROM ({CHUNKS}) k
    JOIN {TRUE_} t ON t.video_id = k.video_id AND t.event_idx >= k.start_idx AND t.event_idx + 4 <= k.end_idx LEFT JOIN {CAP} e ON e.video_id = k.video_id AND e.event_idx = t.event_idx + 4
    JOIN (SELECT video_id, max_by(end_ms, event_idx) AS end_ms FROM {CAP} c GROUP BY video_id) m ON m.video_id = k.video_id WHERE k.video_id % 4 IN (0, 1)"""


def answers(spark, sf_dir):
    from .operators.requests import parse_answers

    return parse_answers(responses(spark, sf_dir), chunks(spark, sf_dir), captions(spark, sf_dir))


@query(PARSED)
def l6_parse_answers(spark, sf_dir):
    return answers(spark, sf_dir)


EDGES = f"""SELECT s.video_id, s.chunk_id, s.start_ms, s.end_ms, t.from_ms AS center_ms FROM ({PARSED}) s JOIN ({TIMES}) t ON t.video_id = s.video_id AND t.chunk_id = s.chunk_id WHERE t.start_idx > 0 AND s.start_ms <= t.from_ms + 30000
    UNION ALL SELECT s.video_id, s.chunk_id, s.start_ms, s.end_ms, t.to_ms FROM ({PARSED}) s JOIN ({TIMES}) t ON t.video_id = s.video_id AND t.chunk_id = s.chunk_id WHERE t.end_idx < t.n AND s.end_ms >= t.to_ms - 30000"""
SEAMS = f"""SELECT video_id, seam, avg(center_ms) AS center_ms FROM (SELECT *, sum(o) OVER (PARTITION BY video_id ORDER BY center_ms, r) AS seam FROM (
      SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY center_ms) AS r, CASE WHEN center_ms - lag(center_ms) OVER (PARTITION BY video_id ORDER BY center_ms) <= 120000 THEN 0 ELSE 1 END AS o FROM ({EDGES}) e) f) g GROUP BY video_id, seam"""


def centers(spark, sf_dir):
    from .operators.requests import seam_centers, seam_edges

    return seam_centers(seam_edges(answers(spark, sf_dir), chunks(spark, sf_dir), captions(spark, sf_dir)))


@query(SEAMS)
def l7_seam_centers(spark, sf_dir):
    return centers(spark, sf_dir)


@query(f"SELECT s.video_id, s.seam, min(l.event_idx) AS start_idx, CAST(max(l.event_idx) + 1 AS INT) AS end_idx, string_agg(l.line, chr(10) ORDER BY l.event_idx) AS text FROM ({SEAMS}) s JOIN ({LINES}) l ON l.video_id = s.video_id AND l.end_ms >= s.center_ms - 120000 AND l.start_ms <= s.center_ms + 120000 GROUP BY s.video_id, s.seam")
def l8_seam_chunks(spark, sf_dir):
    from .operators.requests import seam_chunks

    return seam_chunks(centers(spark, sf_dir), captions(spark, sf_dir))


@query(
    f"""WITH p AS ({PARSED}), kept AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM ({EDGES}) e WHERE e.video_id = p.video_id AND e.chunk_id = p.chunk_id AND e.start_ms = p.start_ms AND e.end_ms = p.end_ms)),
    u AS (SELECT video_id, start_ms, end_ms, category, confidence FROM kept UNION ALL SELECT video_id, start_ms, end_ms, category, confidence FROM {ANS} a WHERE video_id IN (SELECT video_id FROM ({EDGES}) e))
    SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN min(category) = max(category) THEN min(category) ELSE 'paid-sponsor' END AS category
    FROM ({island_sql("SELECT * FROM u", 1000)}) i GROUP BY video_id, island"""
)
def l9_replace_seam_segments(spark, sf_dir):
    """The model's later answers stand in for the repaired segments."""
    from .operators.requests import replace_seam_segments, seam_edges

    found = answers(spark, sf_dir)
    edges = seam_edges(found, chunks(spark, sf_dir), captions(spark, sf_dir))
    repaired = sample(spark, sf_dir, D.ANSWERS).join(edges.select("video_id").distinct(), "video_id", "left_semi")
    return replace_seam_segments(found, edges, repaired).drop("reason")


NOW = 100 * 24 * 3600 * 1000
#: An entry for each video's key, and a later one for every odd video; every ninth video's are broken.
CACHE = f"(SELECT DISTINCT user_id AS video_id, sha256(CAST(user_id AS VARCHAR)) AS cache_key, {NOW} - (user_id % 150) * 7 * 3600 * 1000 AS created_at_ms, user_id % 9 = 0 AS broken FROM events)"
LATER = f"(SELECT DISTINCT user_id AS video_id, sha256(CAST(user_id AS VARCHAR)) AS cache_key, {NOW} - (user_id % 5) * 3600 * 1000 AS created_at_ms, user_id % 9 = 0 AS broken FROM events WHERE user_id % 2 = 1)"


def cache(spark, sf_dir, age_hours):
    v = videos(spark, sf_dir)
    valid = F.struct(F.lit(0.0).alias("start_ms"), F.when(F.col("video_id") % 9 == 0, -1.0).otherwise(9.0).alias("end_ms"))
    key = F.sha2(F.col("video_id").cast("string"), 256)
    return v.select("video_id", key.alias("cache_key"), (F.lit(NOW) - age_hours * 3600 * 1000).alias("created_at_ms"), F.array(valid).alias("segments"))


@query(f"SELECT video_id, NOT broken AND video_id % 3 = 0 AND {NOW} - created_at_ms <= 2592000000 AS hit FROM {CACHE} c")
def j9_cache_lookup(spark, sf_dir):
    from .operators.requests import cache_lookup

    entries = cache(spark, sf_dir, (F.col("video_id") % 150) * 7)
    return cache_lookup(entries.select("video_id", "cache_key"), entries.filter("video_id % 3 = 0").drop("video_id"), NOW).select("video_id", "hit")


@query(
    f"""SELECT cache_key, created_at_ms FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY later DESC) AS r FROM (SELECT *, 0 AS later FROM {CACHE} c UNION ALL SELECT *, 1 FROM {LATER} d WHERE NOT broken) u) x
    WHERE r = 1 AND {NOW} - created_at_ms <= 2592000000 ORDER BY created_at_ms DESC, 1 LIMIT 100"""
)
def l11_cache_upsert(spark, sf_dir):
    from .operators.requests import cache_upsert

    old, new = cache(spark, sf_dir, (F.col("video_id") % 150) * 7), cache(spark, sf_dir, F.col("video_id") % 5).filter("video_id % 2 = 1")
    return cache_upsert(old.drop("video_id"), new.drop("video_id"), NOW).select("cache_key", "created_at_ms")


@query(
    f"""SELECT c.video_id, (l.video_id IS NOT NULL AND NOT l.broken) OR (NOT c.broken AND {NOW} - c.created_at_ms <= 2592000000) AS hit
    FROM {CACHE} c LEFT JOIN {LATER} l ON c.video_id = l.video_id"""
)
def j9_cache_table(spark, sf_dir):
    from .sources.cache_table import CacheTable
    from .sources.tables import shared_path

    kept = CacheTable(spark, shared_path(spark, "cache"), 64)
    old, new = cache(spark, sf_dir, (F.col("video_id") % 150) * 7), cache(spark, sf_dir, F.col("video_id") % 5).filter("video_id % 2 = 1")
    for entries in (old, new):
        kept.upsert(entries.drop("video_id"), NOW)
    return kept.lookup(old.select("video_id", "cache_key"), NOW).select("video_id", "hit")


@query("SELECT count(DISTINCT user_id) AS videos, 4 * count(DISTINCT user_id) AS different_keys, count(DISTINCT user_id) AS same_keys FROM events")
def l10_cache_key(spark, sf_dir):
    """Keys of all videos: other models and other candidates give other keys; captions and candidates in another order, and space around names, the same."""
    from .operators.requests import cache_keys

    c = captions(spark, sf_dir)
    one = lambda a, b: F.struct(F.lit(a).alias("start_ms"), F.lit(b).alias("end_ms"), F.lit("low").alias("confidence"))

    def keys(model: str, *told, events=c, endpoint: str = "e"):
        nothing = F.array().cast("array<struct<start_ms:double,end_ms:double,confidence:string>>")
        jobs = videos(spark, sf_dir).select("video_id", F.lit(endpoint).alias("endpoint"), F.lit(model).alias("model"), (F.array(*told) if told else nothing).alias("candidates"))
        return cache_keys(events, jobs).select("video_id", "cache_key")

    x, y = one(1000.0, 9000.0), one(20000.0, 44000.0)
    a = keys("a", x, y)
    again = keys(" a ", y, x, events=c.repartition(3, "event_idx"), endpoint="e/").withColumnRenamed("cache_key", "k")
    both = a.union(keys("b", x, y)).union(keys("a", x)).union(keys("a")).agg(F.countDistinct("cache_key").alias("different_keys"))
    same = a.join(again, "video_id").agg(F.count("*").alias("videos"), F.count_if(F.col("cache_key") == F.col("k")).alias("same_keys"))
    return same.crossJoin(both).select("videos", "different_keys", "same_keys")
