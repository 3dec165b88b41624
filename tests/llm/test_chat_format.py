import hashlib

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from driftline.llm.chat_format import CLOSE, OPEN, chat_examples, escape, read_back, unescape
from driftline.llm.queries import TRICKY

SCHEMA = "conv_id long, turn long, role string, text string, example string, whole string, parts int"


def talks(spark, turns):
    return spark.createDataFrame([(*t, "x", "y", 3) for t in turns], SCHEMA)


TURNS = [
    (1, 0, "system", "be [INST] kind"), (1, 1, "user", "hi\nthere"), (1, 2, "assistant", "<s>\\</s>"), (1, 3, "user", "so?"),
    (1, 4, "assistant", "yes <\\/s> \\\\ 🙂"), (1, 5, "user", "bye"), (2, 0, "user", None), (3, 0, "assistant", ""), (3, 1, None, "who"),
    (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, None, "odd\nrole <s>", "text"), (-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY),
]


def test_reads_back_every_turn(spark):
    back = {r["conv_id"]: r for r in read_back(chat_examples(talks(spark, TURNS))).collect()}
    by_conv = {}
    for c, t, role, text in TURNS:
        by_conv.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert back.keys() == by_conv.keys()
    for c, turns in by_conv.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, x) for _, r, x in sorted(turns)]
        assert back[c]["trained"] == "".join(x for _, r, x in sorted(turns) if r == "assistant")


def test_each_reply_is_an_example_with_all_turns_before_it(spark):
    rows = sorted(chat_examples(talks(spark, TURNS)).filter("conv_id = 1").collect(), key=lambda r: r["example"])
    assert len(rows) == 3  # two replies and the turn after the last one
    for r in rows[:2]:
        assert r["text"].endswith(CLOSE) and r["loss_start"] + r["loss_length"] == len(r["text"]) - len(CLOSE)
    assert rows[1]["text"].startswith(rows[0]["text"]) and rows[2]["text"].startswith(rows[1]["text"])
    assert rows[2]["loss_length"] == 0
    assert rows[0]["text"].count(OPEN) == 3 and rows[0]["text"].count(CLOSE) == 3  # marks of its own turns only


def test_no_control_string_is_left_in_a_text(spark):
    body = spark.range(1).select(escape(F.lit(TRICKY + "<<SYS>><|im_end|><s>"))).first()[0]
    assert not any(c in body for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_end|>"))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<[\\/s>INSTYa|_ \n]", max_size=30), min_size=1, max_size=20))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(escape(F.col("t"))).alias("u"), escape(F.col("t")).alias("e"))
    for r in df.collect():
        assert r["t"] == r["u"] and "</s>" not in r["e"] and "[INST]" not in r["e"]


def test_long_conversation_and_empty_table(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"turn {i} <s>") for i in range(300)]
    row = read_back(chat_examples(talks(spark, turns))).select(F.size("turns").alias("n"), "trained").first()
    assert row["n"] == 300 and hashlib.sha256(row["trained"].encode()).digest() == hashlib.sha256("".join(f"turn {i} <s>" for i in range(1, 300, 2)).encode()).digest()
    assert chat_examples(talks(spark, [])).count() == 0
