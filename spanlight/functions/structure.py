"""Word-order and fuzzy rules that columns cannot express, as one vectorised helper.

Callers gate it: only texts that can match any rule reach Python.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .. import patterns as P
from .text import SPONSOR_WORDS

# What a sponsor word may refer to, and words that are no brand after it.
CONTENT = frozenset("video episode show podcast".split())
CURRENT = frozenset("this today todays".split())
LINKING = frozenset("is are re be as s".split())
GENERIC = frozenset("program programme initiative project club team group organization organisation department school university event tournament conference role".split())
PREDICATES = frozenset("is can will help helps offer offers provide provides make makes let lets allow allows".split())
WORD_DICE, START_DICE, END_DICE, LONGEST = 0.78, 0.82, 0.84, 500

RULES = ("fuzzy_word", "fuzzy_start", "fuzzy_end", "structural_start", "structural_role")

#: Every word that resembles a sponsor word enough holds one of these.
SPONSOR_GATE = "spo|pon|nso|sor"


@lru_cache(maxsize=100_000)
def _grams(text: str) -> Counter:
    padded = f" {text} "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2))


def similar(a: str, b: str, least: float) -> bool:
    if a == b:
        return True
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    return 2 * (_grams(a) & _grams(b)).total() >= least * (len(a) + len(b))


def fuzzy(normalized: str) -> str:
    return re.sub(r"[^a-z0-9%$]+", " ", normalized).strip()


def has_sponsor_word(clean: str) -> bool:
    return any(len(w) >= 6 and any(similar(w, s, WORD_DICE) for s in SPONSOR_WORDS) for w in clean.split(" "))


def has_phrase(clean: str, phrases: list[str], least: float) -> bool:
    if not clean or len(clean) > LONGEST:
        return False
    words = clean.split(" ")
    for phrase in map(fuzzy, phrases):
        n = phrase.count(" ") + 1
        if phrase in clean:
            return True
        for size in range(max(2, n - 1), min(len(words), n + 2) + 1):
            if any(similar(" ".join(words[i : i + size]), phrase, least) for i in range(len(words) - size + 1)):
                return True
    return False


def structural_start(words: list[str]) -> bool:
    """A sponsor word tied to the current video, in whatever order."""
    content = [c for c, w in enumerate(words) if w in CONTENT and CURRENT & set(words[max(0, c - 2) : c + 3])]
    for s in (k for k, w in enumerate(words) if re.fullmatch("sponsor(?:s|ed|ing|ship)?", w)):
        before = set(words[max(0, s - 6) : s])
        linked = "about" not in before and bool(before & LINKING)
        for c in content:
            if abs(s - c) <= 8 and (linked if c < s else bool({"of", "for"} & set(words[s + 1 : c]))):
                return True
    return False


def structural_role(words: list[str]) -> bool:
    """Our or the sponsor, followed by a name."""
    for s in range(1, len(words)):
        if words[s] not in ("sponsor", "sponsors") or words[s - 1] not in ("our", "the"):
            continue
        rest = words[s + 1 :]
        if not rest:
            if words[s] == "sponsors":
                return True
            continue
        skip = 2 if rest[:2] == ["such", "as"] else 1 if rest[0] in ("like", "including", "is") else 0
        if skip:
            if len(rest) > skip and rest[skip] not in GENERIC:
                return True
        elif rest[0] not in GENERIC and PREDICATES & set(rest[1:7]):
            return True
    return False


@F.pandas_udf(StructType([StructField(k, BooleanType()) for k in RULES]))
def _rules(texts: pd.Series) -> pd.DataFrame:
    def one(text: str | None) -> tuple:
        if text is None:
            return False, False, False, False, False
        clean, words = fuzzy(text), re.sub("[^a-z0-9]+", " ", text).split()
        word = has_sponsor_word(clean)
        end = bool(re.search(P.FUZZY_END_GATE, text, re.A)) and has_phrase(clean, P.FUZZY_END_PHRASES, END_DICE)
        return word, word and has_phrase(clean, P.FUZZY_START_PHRASES, START_DICE), end, structural_start(words), structural_role(words)

    known = {t: one(t) for t in texts.unique()}
    return pd.DataFrame([known[t] for t in texts], columns=list(RULES))


def structure(normalized: Column) -> Column:
    """A struct of the five rules' results; texts that can match none do not reach Python."""
    gate = normalized.rlike(SPONSOR_GATE) | normalized.rlike(P.java(P.FUZZY_END_GATE))
    return _rules(F.when(gate, normalized))
