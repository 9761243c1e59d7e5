"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

The input is an event log: (conv_id, seq, turn, kind, role, text). Per conversation, in the
order of seq, events are folded into final messages:

  open        begins the message of a turn and names its role
  delta       appends streamed text to the turn's message
  edit        replaces the message's text so far
  regenerate  voids all that earlier events said about this turn's text and about later turns

A void event is one before a regenerate event of the same or an earlier turn; it is found by a
running minimum over the conversation from its end, which spills rather than grows. A message
is then the text from its last edit on, in order; the fold never holds more than the events
that survive.

Rendering wraps every message as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts, a
backslash is doubled and every control string gets a backslash after its first character, so
that no control string is left in them and unescaping gives the text back. In roles, `%`, `<`
and line feeds are percent-encoded. The loss mask is a list of [start, end) code point spans
of the formatted string: the escaped texts of assistant messages.

Null texts and roles are empty. A null conv_id is one conversation of its own. Events without
an open event belong to a message with an empty role. Events that share seq fold in the order
of turn, kind and text. Texts may have any length up to what one row of Spark holds; so may a
conversation, which is one row of the result. An empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

#: Control strings of common chat templates.
CONTROL = (
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
_QUOTED = "|".join(r"\Q" + c[1:] + r"\E" for c in CONTROL)


def escape_text(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?=(?:{_QUOTED}))", r"$1\\")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    out = role
    for c, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def unescape_role(role: Column) -> Column:
    out = role
    for c, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages."""
    from_end = W.partitionBy("conv_id").orderBy(F.col("seq").desc(), F.col("turn").desc(), F.col("kind").desc(), F.col("text").desc())
    redone = F.when(F.col("kind") == "regenerate", F.col("turn"))
    later = F.min(redone).over(from_end.rowsBetween(W.unboundedPreceding, -1))
    live = (
        events.select("conv_id", "seq", "turn", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("redone", later)
        # A turn keeps its role when only its own text is voided.
        .filter("redone is null or turn < redone or (turn = redone and kind = 'open')")
    )
    pieces = F.sort_array(F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", "kind", "text"))))
    parts = live.groupBy("conv_id", "turn").agg(F.min(F.when(F.col("kind") == "open", F.struct("seq", "role"))).role.alias("role"), pieces.alias("pieces"))
    last_edit = F.coalesce(F.array_max(F.transform("pieces", lambda p, i: F.when(p.kind == "edit", i))), F.lit(0))
    kept = F.slice("pieces", last_edit + 1, F.greatest(F.size("pieces"), F.lit(1)))
    text = F.array_join(F.transform(kept, lambda p: p.text), "")
    return parts.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): a row per conversation, its messages in the order of turn."""
    one = F.struct("turn", escape_role(F.col("role")).alias("role"), escape_text(F.col("text")).alias("text"))
    listed = messages.select("conv_id", one.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    head = lambda m: F.concat(F.lit(START), m.role, F.lit("\n"))
    formatted = F.array_join(F.transform("ms", lambda m: F.concat(head(m), m.text, F.lit(END + "\n"))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        start = acc.at + F.length(head(m))
        end = start + F.length(m.text)
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(m.role == loss_role, F.concat(acc.spans, span)).otherwise(acc.spans)
        return F.struct((end + len(END) + 1).cast("long").alias("at"), spans.alias("spans"))

    return listed.select("conv_id", formatted.alias("formatted"), F.aggregate("ms", zero, step, lambda a: a.spans).alias("loss_spans"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(fold_events(events), loss_role)


def read_back(formatted: Column) -> Column:
    """The messages of a formatted string: array of (role, text)."""
    marked = F.filter(F.split(formatted, rf"\Q{END}\E\n"), lambda p: p != "")

    def message(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p))
        return F.struct(unescape_role(F.substring(role, F.lit(len(START) + 1), F.length(role))).alias("role"), unescape_text(text).alias("text"))

    return F.transform(marked, message)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """The event log of a table of finished turns (conv_id, turn, role, text).

    Each row is a message, in the order of turn, role and text. An assistant's text comes as a
    draft that is regenerated and then streams in two deltas; any other text as a delta that an
    edit replaces by the whole.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("n"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))

    def event(k: int, kind: str, text: Column) -> Column:
        return F.struct((F.col("n") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    nothing = F.lit("")
    streamed = F.array(event(0, "open", nothing), event(1, "delta", first), event(2, "regenerate", nothing), event(3, "delta", first), event(4, "delta", rest))
    edited = F.array(event(0, "open", nothing), event(1, "delta", first), event(2, "edit", F.col("text")))
    found = rows.select("conv_id", F.col("n").alias("turn"), "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return found.select("conv_id", "e.seq", "turn", "e.kind", F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), "e.text")
