import random

from pyspark.sql import functions as F

from ledgerbeam.llm import chat


def test_escape_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["<", "|", ">", "[", "]", "\\", "/s", "INST", "end", "turn", "a", "\n"]) for _ in range(12)) for _ in range(300)] + ["", "<|end|>", "</s>[INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, back in df.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect():
        assert back == t
        assert not any(c in e for c in ("<|", "[INST]", "</s>", "|>"))


def test_machine_segments_and_read_back(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u<|end|>"), (1, 2, "assistant", "x|"), (1, 3, "user", None), (1, 4, "assistant", "\\"),
        (2, 0, "assistant", "no"), (3, 1, "user", "b"), (3, 0, "user", "a"), (None, 0, None, "z"), (4, 2, "user", "same"), (4, 2, "user", "same"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_chats(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert out[1]["valid"] and out[1]["bad_turn"] is None
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("system", "s"), ("user", "u<|end|>"), ("assistant", "x|"), ("user", ""), ("assistant", "\\")]
    assert [s["text"] for s in out[1]["segments"] if s["loss"]] == ["x|\\", "\\\\"]
    assert out[1]["formatted"] == "".join(s["text"] for s in out[1]["segments"])
    assert (out[2]["valid"], out[2]["bad_turn"]) == (False, 0)
    assert (out[3]["bad_turn"], [t["text"] for t in out[3]["turns"]]) == (1, ["a", "b"])
    assert out[4]["bad_turn"] == 1 and out[None]["bad_turn"] == 0
    assert chat.format_chats(turns.where("false")).count() == 0


def test_the_role_machine_shows_in_the_query(spark, tmp_path):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "user", "x"), (3, 1, "user", "y"), (4, 0, None, None)]
    turns += [(5, i, "user" if i % 2 == 0 else "assistant", "long [turn] " * 200) for i in range(400)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in chat.op6_format_chats(spark, str(tmp_path)).collect()}
    assert got == {-7: (True, None), 1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, 0), 5: (True, None)}
