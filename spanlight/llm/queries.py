"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, quality_classifier, toxicity
from .clustering import cluster_vectors
from .common import table
from .decontaminate import contaminated
from .html_extract import extract_main_text
from .mixing import mix
from .private_data import personal_spans
from .quality_rules import measure_quality
from .simhash import near_duplicates
from .spelling import SpellingOptions, group_spellings
from .substring_dedup import remove_repeats
from .url_filters import judge_urls


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_classifier.train(docs.filter(_fold(3) != 1), labels.filter(_fold(3) != 1))
    found = quality_classifier.score(docs, model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(_fold(5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    found = chat_format.format_chats(chat_format.turns_as_events(turns.unionByName(own)))
    back = found.select("conv_id", "formatted", "loss_spans", chat_format.read_back(F.col("formatted")).alias("ms"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("ms", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("ms").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The fixed rules of the URL query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    told = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", told.alias("centroid_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"), SpellingOptions(typo_every=97))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_url_filters": op3_url_filters,
    "op4_html_extract": op4_html_extract,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_pii": op11_pii,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Control strings as a regular expression for the escaped length: backslashes double, control strings grow by one.
_CONTROL = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"

def _clusters_sql(clusters: int, rounds: int) -> str:
    """Rounds of assignment over all pairs of vectors and centroids."""
    nearest = """a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS b FROM (
        SELECT r, vec_id, kept.v, c, CAST(list_sum(list_transform(list_zip(kept.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, m{k} m) x GROUP BY r)"""
    moved = """m{n} AS MATERIALIZED (SELECT m.c, coalesce(n.v, m.v) AS v FROM m{k} m LEFT JOIN (
        SELECT c, list(mean ORDER BY i) AS v FROM (SELECT b.c AS c, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS mean FROM a{k}, range(1, 65) t(i) GROUP BY b.c, i) y GROUP BY c) n ON n.c = m.c)"""
    parts = []
    for k in range(rounds):
        parts += [nearest.format(k=k), moved.format(k=k, n=k + 1)]
    parts.append(nearest.format(k=rounds))
    return f"""WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h, v LIMIT {clusters}) f),
        {", ".join(parts)}
        SELECT vec_id, CAST(b.c AS INT) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
               sha256(list_aggregate(m.v, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} a JOIN m{rounds} m ON m.c = a.b.c"""


ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
                      + len(regexp_extract_all(text, '"""
    + _CONTROL
    + r"""')) AS escaped,
                   length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) AS role_chars
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(12 + role_chars + 1 + escaped + 11) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op3_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        bare AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM parts),
        split AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
            FROM bare),
        rules(verdict, rule_host, rule_path) AS (VALUES
            ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
            SELECT s.page_id, s.host, s.path, r.verdict, r.rule_host || r.rule_path AS rule
            FROM split s LEFT JOIN rules r
              ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
        QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) = 1""",
    "op12_centroid_clustering": _clusters_sql(40, 5),
    "op13_spelling_variants": r"""
        WITH RECURSIVE steps AS (
            SELECT list(t ORDER BY b) AS t FROM (
                SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])),
                    lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS t FROM range(256) r(b)) x),
        runs AS (
            SELECT doc_id, w, count(*) AS n FROM (
                SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
                       unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) u
            GROUP BY doc_id, w),
        bytes AS (
            SELECT w, n, list_transform(range(0, length(x) // 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1 AS UBIGINT)) AS b
            FROM (SELECT w, n, hex(encode(doc_id || ':' || w)) AS x FROM runs) y),
        marked AS (
            SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), b), lambda a, x: xor(a >> 8, t[1 + CAST(xor(a, x) & 255 AS INTEGER)])), 4294967295) AS h FROM bytes, steps),
        words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM marked) z
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        without AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) d),
        longer AS (SELECT DISTINCT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM words a JOIN without b ON b.k = a.word),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON b.i = a.i AND b.k = a.k AND b.word <> a.word
            UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(m := -other_n, o := other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        forms AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word),
        walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word JOIN forms e ON e.word = k.at AND e.form IS NULL""",
}
