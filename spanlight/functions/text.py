"""Text functions of captions, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import patterns as P

#: White space of captions, beyond ASCII too.
SPACE = r"[\s   -     　﻿]+"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def normalize_text(text: Column, ascii_only: bool = False) -> Column:
    """Compatibility-composed, straight apostrophes, single spaces, trimmed, lower case; null: empty.

    Only texts beyond ASCII pass through Python; ascii_only leaves composition out.
    """
    text = F.coalesce(text, F.lit(""))
    if not ascii_only:
        text = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return F.lower(collapse(F.translate(text, "’‘", "''")))


def normalize_fuzzy(normalized: Column) -> Column:
    return F.trim(F.regexp_replace(normalized, r"[^a-z0-9%$]+", " "))


def matches(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches; texts in ASCII, nearly all, take Java's own, faster word boundary."""
    plain = "|".join(f"(?:{p})" for p in patterns)
    return F.when(text.rlike(r"[^\x00-\x7F]"), text.rlike(P.either(patterns))).otherwise(text.rlike(plain))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(P.java(pattern)), F.lit(group))


def promo_codes(text: Column, normalized: Column) -> Column:
    """Lower-cased promo codes, each once, sorted."""
    lower = lambda found: F.transform(found, F.lower)
    nothing = F.array().cast("array<string>")
    own = F.concat(lower(_all(text, P.CODE_LABELLED)), lower(_all(text, P.CODE_OWNED)), lower(_all(text, P.CODE_UPPER)))
    plain = F.when(normalized.rlike(P.java(P.OFFER_CONTEXT)), _all(normalized, P.CODE_PLAIN)).otherwise(nothing)
    return F.when(normalized.contains("code"), F.array_sort(F.array_distinct(F.concat(own, plain)))).otherwise(nothing)


def _no_brands() -> Column:
    return F.array(*map(F.lit, dict.fromkeys(P.NO_BRANDS)))


def domain_roots(normalized: Column) -> Column:
    return F.array_sort(F.array_except(_all(normalized, P.DOMAIN_ROOT), _no_brands()))


def named_brands(normalized: Column) -> Column:
    """The first name after each kind of disclosure."""
    found = F.array(*(F.regexp_extract(normalized, P.java(p), 1) for p in P.NAMED_BRAND))
    return F.array_sort(F.array_except(F.array_except(found, F.array(F.lit(""))), _no_brands()))


def capitalized_brands(text: Column, has_cue: Column, codes: Column) -> Column:
    """Capitalised words of texts with a precise or sponsor signal, without promo codes."""
    words = F.transform(_all(text, P.CAPITALISED, 0), F.lower)
    found = F.array_sort(F.array_except(F.array_except(words, _no_brands()), codes))
    return F.when(has_cue, found).otherwise(F.array().cast("array<string>"))


def tokens(normalized: Column) -> Column:
    return _all(normalized, P.TOKEN, 0)


def topic_tokens(normalized: Column) -> Column:
    """Tokens that are neither stop words nor commercial words, repeats included."""
    words = list(dict.fromkeys([*P.STOP_WORDS, *P.COMMERCIAL_WORDS]))
    return F.filter(tokens(normalized), lambda t: ~t.isin(words))


def grams(text: Column, size: int = 3) -> Column:
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    n = F.length(padded) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(padded, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def dice(left: Column, right: Column, size: int = 3) -> Column:
    """Similarity of the n-gram multisets: 1 if equal, 0 if one is empty."""
    count = lambda xs, x: F.size(xs) - F.size(F.array_remove(xs, x))

    def ratio(s: Column) -> Column:
        shared = F.aggregate(F.array_intersect(s.a, s.b), F.lit(0), lambda acc, x: acc + F.least(count(s.a, x), count(s.b, x)))
        return 2.0 * shared / (F.size(s.a) + F.size(s.b))

    # The n-grams of both stand in a struct that a lambda holds: a column of them would be worked out at each mention.
    held = F.array(F.struct(grams(left, size).alias("a"), grams(right, size).alias("b")))
    alike = F.get(F.transform(held, ratio), F.lit(0))
    return F.when(left == right, 1.0).when((left == "") | (right == ""), 0.0).otherwise(alike)


SPONSOR_WORDS = ("sponsor", "sponsored", "sponsoring", "sponsorship")


def segment_key(start_s: Column, end_s: Column) -> Column:
    tenth = lambda x: F.floor(x * 10 + 0.5).cast("string")
    return F.concat_ws(":", tenth(start_s), tenth(end_s))


def format_duration(seconds: Column) -> Column:
    whole = F.floor(F.greatest(seconds, F.lit(0.0)) + 0.5)
    minutes, rest = F.floor(whole / 60), whole % 60
    text = lambda x: x.cast("string")
    return F.when(minutes <= 0, F.concat(text(rest), F.lit("s"))).when(rest == 0, F.concat(text(minutes), F.lit("m"))).otherwise(F.concat(text(minutes), F.lit("m "), text(rest), F.lit("s")))


def normalize_handle(handle: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(handle, F.lit(""))))
    return F.when(clean == "", "").when(clean.startswith("@"), clean).otherwise(F.concat(F.lit("@"), clean))


def video_id_from_url(url: Column) -> Column:
    """The id in a watch, shorts or embed url; null if there is none."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    watch = F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?v=([^&#]*)", 1)
    short = F.regexp_extract(path, r"^/(?:shorts|embed)/([^/?]+)", 1)
    found = F.when(path == "/watch", watch).otherwise(short)
    return F.when(found != "", found)
