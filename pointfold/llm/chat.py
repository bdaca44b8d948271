"""Operator 2: conversations to training examples, one for each assistant turn.

The template writes each turn as <|im_start|>role, a line break, the text and <|im_end|>, a line break. In roles
and texts every backslash is doubled and <| becomes <\\|, so no text can hold a mark and all can be read back; a
line break in a role is written as <\\>.

An example's context is everything before its reply, and a conversation's contexts are prefixes of one another, so
the formatted conversation is stored once and an example holds the length of its context and its reply's place in
it; `with_context` cuts the texts out where they are needed.

Result for odd input: a null text or role is empty; turns go by (turn, role, text), nulls first, so ties and repeated
rows are all kept, in a defined order; rows with a null conv_id are one conversation; conversations without an
assistant turn have no example; other columns are ignored; an empty table gives an empty result. One conversation is
one row, so it must fit in a task, as its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Of conversation -1, whose texts hold the template's own marks.
PROBE = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, replies: array of (turn_index, start, chars), the place of each assistant text, without its marks."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    role = lambda t: F.replace(escaped(t["role"]), F.lit("\n"), F.lit("<\\>"))
    conv = conv.select("conv_id", F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), role(t), F.lit("\n")).alias("head"), F.concat(escaped(t["text"]), F.lit(END)).alias("body"), (t["role"] == "assistant").alias("reply"))).alias("turns"))
    conv = conv.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "").alias("formatted"), F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["reply"].alias("reply"))).alias("sizes"))
    # the places, by a running sum over the turns' lengths: starts as an array of ends, one longer than the turns
    ends = F.expr("aggregate(sizes, struct(0 AS at, cast(array() AS array<struct<turn_index:int,start:int,chars:int,reply:boolean>>) AS places), (a, t) -> struct(a.at + t.head + t.body AS at, concat(a.places, array(struct(size(a.places) AS turn_index, a.at + t.head AS start, t.body - %d AS chars, t.reply AS reply))) AS places))" % len(END))
    conv = conv.select("conv_id", "formatted", F.filter(ends["places"], lambda p: p["reply"]).alias("replies"))
    return conv.select("conv_id", "formatted", F.transform("replies", lambda p: F.struct(p["turn_index"].alias("turn_index"), p["start"].alias("start"), p["chars"].alias("chars"))).alias("replies"))


def examples(conversations: DataFrame) -> DataFrame:
    """Of formatted conversations an example for each assistant turn: conv_id, turn_index, context_chars (a prefix of `formatted`, all under no loss), target (escaped text, the only part under loss)."""
    e = conversations.select("conv_id", "formatted", F.explode("replies").alias("r"))
    return e.select("conv_id", F.col("r.turn_index").alias("turn_index"), F.col("r.start").alias("context_chars"), F.expr("substring(formatted, r.start + 1, r.chars)").alias("target"))


def with_context(conversations: DataFrame) -> DataFrame:
    """The examples with their contexts written out: as long as the square of a conversation's turns."""
    e = conversations.select("conv_id", "formatted", F.explode("replies").alias("r"))
    return e.select("conv_id", F.col("r.turn_index").alias("turn_index"), F.expr("substring(formatted, 1, r.start)").alias("context"), F.expr("substring(formatted, r.start + 1, r.chars)").alias("target"))


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    head = len(START)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescaped(F.replace(F.substring(role, head + 1, 2**31 - 1), F.lit("<\\>"), F.lit("\n"))).alias("role"), unescaped(p.substr(F.length(role) + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    conv = formatted(turns.unionByName(probe))
    replies = examples(conv).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", unescaped(F.col("target")).alias("text")))).alias("r"))
    loss = replies.select(F.col("conv_id").alias("of"), F.array_join(F.col("r.text"), "").alias("loss"))
    back = conv.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    back = back.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"))
    out = back.join(loss, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    text = F.coalesce("loss", F.lit(""))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars")


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(len(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), '<' || chr(92) || '>'))
      + len(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 24) AS size
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM c
"""
