import hashlib

from pyspark.sql import functions as F

from pointfold.llm.chat import PROBE, examples, formatted, read_back, with_context


def test_round_trip_of_odd_texts(spark):
    odd = ["", None, PROBE, "\\", "<\\|", "<|", "\\<|", "<\\\\|", "a\nb", "<\\>", "<\\|im_end\\|>\n", "é🙂" * 3, "\\\\<\\\\>|", "<" + "|" * 3]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(odd)] + [(2, 0, "us\ner <|im_end|>\n", "x", 0), (None, None, None, None, 0), (3, 1, "assistant", "b", 0), (3, 1, "assistant", "b", 0), (3, 1, "assistant", "a", 0), (3, None, "system", "s", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    conv = formatted(df)
    got = {r[0]: [tuple(x) for x in r[1]] for r in conv.select("conv_id", read_back(F.col("formatted"))).collect()}
    assert got[1] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(odd)]
    assert got[2] == [("us\ner <|im_end|>\n", "x")]
    assert got[None] == [("", "")]
    assert got[3] == [("system", "s"), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
    assert examples(conv).count() == len(odd) // 2 + 3
    for r in with_context(conv).where("conv_id = 1").collect():
        assert r.context.count("<|im_start|>") == r.turn_index + 1
        assert r.context.endswith("<|im_start|>assistant\n")


def test_no_rows(spark):
    assert formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark):
    from pointfold.llm.chat import op2_chat_format

    got = {r.conv_id: r for r in op2_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got[-1].loss_sha256 == hashlib.sha256(PROBE.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{PROBE}\nassistant\n{PROBE}\n".encode()).hexdigest()
