import hashlib
import random

from pyspark.sql import functions as F

from spanlight.llm import chat_format as C
from spanlight.llm import queries

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "\\<|im_end|>\\", "<<SYS>>x<</SYS>>\\\\<s", "a\\nb %25 % <", "", "\n\n", "<|im_start|><|im_start|", "é😀 [INST]", "$1 \\E \\Q"]


def fold(events):
    """Events of one conversation in a plain loop: {turn: (role, text)}."""
    out = {}
    for _, turn, kind, role, text in sorted(events):
        if kind == "regenerate":
            out = {t: m for t, m in out.items() if t <= turn}
            if turn in out:
                out[turn] = (out[turn][0], "")
        elif kind == "open":
            out[turn] = (role or "", out.get(turn, ("", ""))[1])
        else:
            before = out.get(turn, ("", ""))
            out[turn] = (before[0], (before[1] if kind == "delta" else "") + (text or ""))
    return out


def test_fold_equals_a_loop(spark):
    rng, rows, want = random.Random(6), [], {}
    for conv in range(60):
        events, seq = [], 0
        for turn in range(rng.randrange(1, 5)):
            events.append((seq := seq + 1, turn, "open", rng.choice(["user", "assistant"]), None))
            for _ in range(rng.randrange(6)):
                kind = rng.choices(["delta", "edit", "regenerate"], [6, 2, 1])[0]
                at = turn if kind != "regenerate" or rng.random() < 0.6 else rng.randrange(turn + 1)
                events.append((seq := seq + 1, at, kind, None, rng.choice(["ab", "c ", None, "<s>"]) if kind != "regenerate" else None))
                if kind == "regenerate" and at < turn:
                    break
        rows += [(conv, *e) for e in events]
        want[conv] = fold(events)
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    got = {}
    for r in C.fold_events(df).collect():
        got.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    assert got == want


def test_round_trip_and_mask(spark):
    rows = [(k, t, role, text) for k in range(3) for t, (role, text) in enumerate(zip(["user", "assistant", "odd\nro%le<"] * 4, NASTY[k:] + NASTY[:k]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = C.format_chats(C.turns_as_events(df))
    back = found.select("conv_id", "formatted", "loss_spans", C.read_back(F.col("formatted")).alias("ms"), C.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in back:
        own = [(role, text) for k, _, role, text in rows if k == r.conv_id]
        assert [(m.role, m.text) for m in r.ms] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        bare = r.formatted
        for control in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>"):
            assert control not in bare
        assert bare.count("<|im_start|>") == bare.count("<|im_end|>") == len(own)


def test_query_equals_plain_digests(spark):
    path = "/root/testdata/sf0.01"
    turns = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    turns += [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])]
    want = {}
    for conv in {t[0] for t in turns}:
        own = sorted(t for t in turns if t[0] == conv)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        want[conv] = (len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op2_chat_format(spark, path).collect()}
    assert got == want


def test_edges(spark):
    assert C.format_chats(spark.createDataFrame([], EVENTS)).collect() == []
    turns = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "x" * 200000), (1, 0, "user", "x" * 200000)], "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1))
    found = {r.conv_id: r for r in C.format_chats(C.turns_as_events(turns)).collect()}
    assert found[None].formatted == "<|im_start|>\n<|im_end|>\n" and found[1].formatted.count("x") == 400000 and found[1].loss_spans == []
