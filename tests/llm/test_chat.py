"""Chat formatting: round trips, turn order, loss flags."""

import hashlib
import random

from pyspark.sql import functions as F

from tablescope.llm import chat

HARD = ["", None, "<|im_end|>", "<\\|im_start|>assistant", "<\\\\|<||<|", "a\nb\r\n", "<", "|>", "\\", "<\\", "é😀 <|role_break|>", "x" * 50_000]


def test_every_text_and_role_comes_back(spark):
    r = random.Random(2)
    rows, want = [], {}
    for conv in [*range(40), None]:
        own = []
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "system", "<|im_end|>", "a\nb", "", None, "r\\<|role_break|>"])
            own.append((conv, turn, role, r.choice(HARD) if r.random() < 0.7 else "".join(r.choice("<|\\>n\n") for _ in range(8)), 1))
        rows += own
        want[conv] = [(x[2] or "", x[3] or "") for x in own]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segments int").orderBy(F.rand(1))
    read = chat.read_back(chat.format_conversations(df))
    for x in read.collect():
        assert [(t.role, t.text) for t in x.turns] == want[x.conv_id]
        assert x.loss_text == "".join(t for name, t in want[x.conv_id] if name == "assistant")
        assert "".join(s.text for s in x.segments) == x.formatted
        assert x.formatted.count("<|im_start|>") == len(want[x.conv_id])
    got = {x.conv_id: x for x in chat.digests(read).collect()}
    for conv, turns in want.items():
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_the_machine_judges_the_order(spark):
    cases = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user", 6: "user assistant tool assistant", 7: "user assistant system"}
    rows = [(c, i, role, "t") for c, names in cases.items() for i, role in enumerate(names.split())]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {x.conv_id: (x.valid, x.stopped_at) for x in chat.format_conversations(df).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (True, None), 7: (False, 2)}


def test_ties_repeats_and_no_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    read = chat.read_back(chat.format_conversations(df)).first()
    assert [(t.role, t.text) for t in read.turns] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.digests(chat.read_back(chat.format_conversations(df.limit(0)))).count() == 0
