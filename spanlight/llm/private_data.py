"""Personal data: spans found by form, and the terms around them that would give them away.

Every mail address, IP address, card number and telephone number is a protected entity, known by
its normal form. The corpus tells how strongly a term reveals one: over all documents, with e
the entity, t a term, p(e) and p(t) the shares of documents that hold them and p(e, t) the share
in which t stands in the context of e, the pointwise mutual information log2 p(e, t) / (p(e) p(t)) is
what t tells of the information -log2 p(e) of e. What is left of it, -log2 p(e | t), is the
number of bits that still protect e from a reader of t. In a text that mentions e with t in its
context, every t is removed if at most `remove_bits` are left (the default: at least half of the
documents with t name e there), and generalised to the class of its form, a number, a name or
a word, if at most `generalise_bits` are. Bits left mean the same at every size of the corpus.

An estimate needs evidence: a pair counts from `least_texts` different texts on. Exact copies
are one text here, so a document that is copied often is no evidence against its own words.

Contexts are the `reach` terms on either side. A term is a run of letters and digits of
at least `shortest` characters that touches no protected span; case does not count. Terms are
counted in each task before they are shuffled; pairs are partial aggregates; joins are plain
and carry no texts, so an entity, a term or a text that a third of all documents share fills no task.

Found forms, leftmost and non-overlapping per kind: see PATTERNS. A card number has 16 to 19
digits and passes Luhn's test, a telephone number has 8 to 15 digits, the parts of an IP
address are at most 255; matches that fail are dropped, without another try. Spans of different kinds may
overlap. Time is linear in the length of a text, of which every part is looked at.

Null texts are empty and have no spans. Repeated rows and ids get equal spans for equal texts. Columns
beside id and text pass through `sanitise` and are otherwise not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, as_bytes, free_names

KINDS = ("email", "ip", "card", "phone")
#: The kinds of spans that the corpus adds.
ADDED = ("removed", "generalised")

#: Each starts only where a run of its characters does, and never gives characters back, so time is linear.
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A mail address may start inside a run where the one before has ended.
_NEXT_EMAIL = re.compile(PATTERNS["email"].pattern.partition(")")[2])
_NO_DIGIT = re.compile(r"[^0-9]+")
_SIGN = re.compile(r"[@0-9]")
_TERM = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class PrivacyOptions:
    reach: int = 10
    shortest: int = 3
    least_texts: int = 3
    remove_bits: float = 1.0
    generalise_bits: float = 2.0
    #: Terms whose counts a task holds before it hands them on.
    held: int = 300_000


def luhn(digits: str) -> bool:
    doubled = (d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return sum(doubled) % 10 == 0


def _emails(text: str) -> Iterator[re.Match]:
    at = 0
    while m := (at and _NEXT_EMAIL.match(text, at)) or PATTERNS["email"].search(text, at):
        yield m
        at = m.end()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def entities(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normal form) by kind and start, in code points."""
    if not _SIGN.search(text):
        return []
    out = []
    if "@" in text:
        out += [("email", *m.span(), m[0].lower()) for m in _emails(text)]
    for m in PATTERNS["ip"].finditer(text):
        if all(map(_small, m.groups())):
            out.append(("ip", *m.span(), ".".join(p.lstrip("0") or "0" for p in m.groups())))
    for m in PATTERNS["card"].finditer(text):
        digits = _NO_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span(), digits))
    if "+" in text:
        for m in PATTERNS["phone"].finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 8 <= len(digits) <= 15:
                out.append(("phone", *m.span(), digits))
    return out


def terms(text: str, shortest: int) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), *m.span()) for m in _TERM.finditer(text) if m.end() - m.start() >= shortest]


def _free(found: list[tuple[str, int, int]], spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The terms that touch none of the spans; both are in order of their starts."""
    out, k, reached = [], 0, -1
    for t in found:
        while k < len(spans) and spans[k][0] < t[2]:
            reached = max(reached, spans[k][1])
            k += 1
        if reached <= t[1]:
            out.append(t)
    return out


def contexts(text: str, found: list[tuple[str, int, int, str]], options: PrivacyOptions) -> set[tuple[str, str]]:
    """(entity, term) for every term in the context of an entity; entities by a hash."""
    spans = sorted((a, b) for _, a, b, _ in found)
    free = _free(terms(text, options.shortest), spans)
    out, before = set(), 0
    for kind, start, _, value in sorted(found, key=lambda e: e[1]):
        while before < len(free) and free[before][1] < start:
            before += 1
        e = xxhash.xxh3_128_hexdigest(f"{kind}:{value}")
        out.update((e, t[0]) for t in free[max(0, before - options.reach) : before + options.reach])
    return out


def told(spans: list[tuple[str, int, int]]) -> str:
    """Spans as kind:start:end, by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: ((*KINDS, *ADDED).index(s[0]), s[1])))


def added(text: str, found: list[tuple[str, int, int, str]], remove: set[str], generalise: set[str], options: PrivacyOptions) -> list[tuple[str, int, int]]:
    free = _free(terms(text, options.shortest), sorted((a, b) for _, a, b, _ in found))
    return [("removed" if t in remove else "generalised", a, b) for t, a, b in free if t in remove or t in generalise]


def _class(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[0].isupper() else "[WORD]"


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with protected spans as their kinds, general terms as their classes, and without removed ones; what overlaps is one span of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "" if kind == "removed" else _class(text[a:b]) if kind == "generalised" else f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, text_key string, pairs array<struct<entity:string,term:string>>, own_text string"


def _text(raw: bytes) -> str:
    return raw.decode(errors="replace")


def find_entities(docs: DataFrame, options: PrivacyOptions = PrivacyOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: the protected spans; for texts that have some also a key that equal texts share, the terms around them, and the text."""

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        pair = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
        kinds = [kind, *[pa.int64()] * 4, *[pa.string()] * 3, pair, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[doc_id, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "text_key", "pairs", "own_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            rows, held = [], 0
            for own, raw in zip(b.column(0).to_pylist(), as_bytes(b, text)):
                t = _text(raw)
                if not (found := entities(t)):
                    rows.append((own, 0, 0, 0, 0, nothing, "", None, None, None))
                else:
                    n, base = Counter(e[0] for e in found), told([e[:3] for e in found])
                    pairs = [{"entity": e, "term": w} for e, w in sorted(contexts(t, found, options))]
                    rows.append((own, *(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, hashlib.sha256(raw).hexdigest(), pairs, t))
                    held += 60 * len(pairs) + len(t)
                if held > 8 << 20:  # long texts go on in small batches
                    yield batch_of(rows, b.schema.field(0).type)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, b.schema.field(0).type)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, {FOUND}")


def term_counts(docs: DataFrame, options: PrivacyOptions = PrivacyOptions(), text: str = "text") -> DataFrame:
    """(term, n_term): the number of documents with each term."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n_term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for raw in as_bytes(b, text):
                counts.update({w.lower() for w in set(_TERM.findall(_text(raw))) if len(w) >= options.shortest})
                if len(counts) > options.held:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    return docs.select(text).mapInArrow(run, "term string, n_term long").groupBy("term").agg(F.sum("n_term").alias("n_term"))


def disclosures(found: DataFrame, docs: DataFrame, options: PrivacyOptions = PrivacyOptions(), text: str = "text") -> DataFrame:
    """(entity, term, n_both, n_term, bits_left): the pairs in which the term reveals the entity, with the documents behind them."""
    each = found.filter("text_key is not null").select("text_key", F.inline("pairs"))
    texts = each.groupBy("entity", "term", "text_key").agg(F.count("*").alias("n"))
    pairs = texts.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("n_both")).filter(F.col("texts") >= options.least_texts)
    left = F.log2(F.col("n_term") / F.col("n_both"))
    rows = pairs.join(term_counts(docs, options, text), "term").withColumn("bits_left", left)
    return rows.filter(F.col("bits_left") <= max(options.remove_bits, options.generalise_bits)).select("entity", "term", "n_both", "n_term", "bits_left")


def terms_to_hide(found: DataFrame, revealing: DataFrame, options: PrivacyOptions = PrivacyOptions()) -> DataFrame:
    """(text_key, remove, generalise): the terms of every text that reveal an entity in whose context they stand there."""
    each = found.filter("text_key is not null").select("text_key", F.inline("pairs")).join(revealing.select("entity", "term", "bits_left"), ["entity", "term"])
    least = each.groupBy("text_key", "term").agg(F.min("bits_left").alias("bits"))
    gone = F.col("bits") <= options.remove_bits
    return least.groupBy("text_key").agg(F.collect_list(F.when(gone, F.col("term"))).alias("remove"), F.collect_list(F.when(~gone, F.col("term"))).alias("generalise"))


def personal_spans(docs: DataFrame, options: PrivacyOptions = PrivacyOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, clean_text) of every row; clean_text is null where nothing changes."""
    staged = Staged(docs.sparkSession, "privacy")
    found = staged.put(find_entities(docs, options, doc_id, text), "found")
    hidden = terms_to_hide(found, staged.put(disclosures(found, docs, options, text), "revealing", tidy=False), options)
    some = found.filter("text_key is not null").drop("pairs").join(staged.put(hidden, "hidden", tidy=False), "text_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, clean = [], []
            for t, remove, generalise in zip(*(b.column(k).to_pylist() for k in ("own_text", "remove", "generalise"))):
                hits = entities(t)
                all_ = [e[:3] for e in hits] + (added(t, hits, set(remove or ()), set(generalise or ()), options) if remove or generalise else [])
                spans.append(told(all_))
                clean.append(redacted(t, all_))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(spans, pa.string()), pa.array(clean, pa.string())], names=[*cols, "spans", "clean_text"])

    cols = [doc_id, "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"`{doc_id}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean_text string"
    marked = some.select(*cols, "own_text", "remove", "generalise").mapInArrow(run, shape)
    plain = found.filter("text_key is null").select(*cols, F.col("base").alias("spans"), F.lit(None).cast("string").alias("clean_text"))
    return marked.unionByName(plain)


def sanitise(docs: DataFrame, options: PrivacyOptions = PrivacyOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with their columns and sanitised texts; texts meet the terms to hide by a hash of theirs, in one shuffle of the texts that have protected spans."""
    staged = Staged(docs.sparkSession, "sanitise")
    found = staged.put(find_entities(docs, options, doc_id, text), "found")
    hidden = staged.put(terms_to_hide(found, disclosures(found, docs, options, text), options), "hidden", tidy=False)
    key, told_ = free_names(docs, "text_key", "hidden")
    own = hidden.select(F.col("text_key").alias(key), F.struct("remove", "generalise").alias(told_))

    @F.pandas_udf("string")
    def cleaned(texts, hidden):
        out = []
        for t, remove, generalise in zip(texts, hidden["remove"], hidden["generalise"]):
            hits = entities(t) if t else []
            all_ = [e[:3] for e in hits] + (added(t, hits, set(() if remove is None else remove), set(() if generalise is None else generalise), options) if hits and remove is not None else [])
            out.append(redacted(t, all_) if all_ else t)
        return type(texts)(out)

    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(own, key, "left")
    blank = F.struct(F.array().cast("array<string>").alias("remove"), F.array().cast("array<string>").alias("generalise"))
    return keyed.withColumn(text, cleaned(F.col(text), F.coalesce(told_, blank))).select(docs.columns)
