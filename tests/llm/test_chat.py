import hashlib
import random
import re
import time

import pytest

from pyspark.sql import functions as F

from fieldloom.llm import chat, queries

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "[TURN]", "[ROLE]", "[/ROLE]", "[SYS]", "<\\/s>", "[\\\\INST]"]
COLUMNS = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(rows, found, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
    convs = {}
    for r in sorted(rows, key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert {r.conv_id for r in found} == set(convs) and len(found) == len(convs)
    for r in found:
        turns = convs[r.conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        blocks = sum(i == 0 or turns[i - 1][0] != turns[i][0] for i in range(len(turns)))
        assert (r.n_turns, r.turns_sha256, r.n_blocks) == (len(turns), digest("".join(f"{a}\n{t}\n" for a, t in turns)), blocks)
        assert (r.loss_chars, r.loss_sha256) == (len(learned), digest(learned))


def test_random_turns_come_back(spark):
    rng = random.Random(5)
    pieces = [*CONTROL, "\\", "<", "[", "]", ">", "/s>", "s>", "INST]", "a", "é日", " ", "\n"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))])
    roles = ["user", "assistant", "assistant", "system", "tool", "", None, "[TURN]x", "a</s>"]
    rows = [(rng.choice([None, *range(40)]), t, rng.choice(roles), text()) for t in range(600)]
    rows += rows[:20]
    check(rows, chat.round_trip(spark.createDataFrame(rows, COLUMNS).repartition(5)).collect())


def test_defined_cases(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, None, "system", "first"), (1, 2, "user", "b"), (1, 3, "assistant", "x"), (1, 3, "assistant", "c"), (2, 0, None, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{COLUMNS}, turns string, formatted int")
    check(rows, chat.round_trip(df).collect())
    texts = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert texts[1].formatted == "[SYS]first[/SYS][INST]a[TURN]b[TURN]b[/INST]<s>c[TURN]x</s>"
    assert [texts[1].formatted[s.start : s.start + s.length] for s in texts[1].loss] == ["c", "x"]
    assert (texts[2].formatted, texts[2].loss) == ("[ROLE][TURN][/ROLE]", [])
    assert chat.round_trip(df.limit(0)).count() == 0


def test_probe_is_escaped(spark):
    rows = spark.createDataFrame([(3, 0, "user", "hello")], COLUMNS)
    out = {r.conv_id: r for r in chat.format_chats(chat.with_probe(rows)).collect()}
    assert out[-7].formatted == r"[INST]<\/s>[\INST] ok [\/INST][/INST]<s><\/s>[\INST] ok [\/INST]</s>" and out[3].formatted == "[INST]hello[/INST]"
    assert "".join(re.split(r"\[/?INST\]|</?s>", out[3].formatted)) == "hello"


def test_escaping_is_a_bijection(spark):
    texts = [a + b + c for a in ("", "<", "[", "\\") for b in CONTROL for c in ("", "s>", "\\", "[")] + ["plain [1] a < b \\n"]
    t = chat.Template()
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", t.escape(F.col("text")).alias("e")).withColumn("back", t.unescape(F.col("e"))).collect()
    for r in rows:
        assert r.back == r.text and not any(s in r.e for s in t.strings)
    assert len({r.e for r in rows}) == len(set(texts)) and rows[-1].e == texts[-1]


def test_long_conversation_is_no_square(spark):
    """20,000 turns take far less than a hundred times as long as 2,000; one turn is very long."""
    made = lambda n: spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s>"), F.repeat(F.lit("é "), F.when(F.col("id") == 7, 500_000).otherwise(20))).alias("text"))
    took = []
    for n in (2_000, 2_000, 20_000):
        began = time.time()
        (row,) = chat.round_trip(made(n)).collect()
        took.append(time.time() - began)
        assert row.n_turns == n and row.loss_chars == 44 * (n // 2 - 1) + 4 + 1_000_000
    assert took[2] < 25 * took[1] + 5


def test_templates_that_are_not_reversible():
    for bad in ({"seam": "<s>"}, {"seam": "x"}, {"seam": "<a<"}, {"other": ("[A\\]", "[/A]")}):
        with pytest.raises(ValueError):
            chat.Template(**bad)
    assert chat.Template(marks={"user": ("<u>", "</u>"), "model": ("<m>", "</m>")}, learned="model").rests


def test_no_python_in_the_plan(spark):
    df = queries.op11_chat_formatting(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    stored = chat.format_chats(chat.with_probe(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "ExistingRDD"):
        assert word not in plan + stored
