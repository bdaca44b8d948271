"""Counters of parts that move together, kept by pair over a stream of moves and resets.

A pair's counter is 3 * both - (moves of one) - (moves of the other), from the frame in which it began. So a part needs only its number of moves
and its last reset, and a pair only what both numbers were when it began and how often both moved: a frame touches the
parts that move in it and pairs that move together, not every pair of a part. A reset of a part is kept with it, as a tombstone of all
its pairs on either side: a pair that began before it doesn't count and begins anew when both move again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointfold.operators.cut import cut
from pointfold.streaming.versions import Versions

SCHEMAS = {"parts": "label long, moves long, reset long", "pairs": "a long, b long, began long, both long, of_a long, of_b long"}


def step(parts: DataFrame, pairs: DataFrame, moves: DataFrame, resets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after the moves and resets (frame, label) of some frames, all later than those before."""
    moves = cut(moves.select(F.col("frame").cast("long").alias("frame"), F.col("label").cast("long").alias("label")).distinct())
    new = moves.groupBy("label").agg(F.count("*").alias("new"))
    last = resets.groupBy(F.col("label").cast("long").alias("label")).agg(F.max("frame").cast("long").alias("anew"))
    known = cut(parts.join(new, "label", "full_outer").join(last, "label", "full_outer").select("label", F.coalesce("moves", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"), F.greatest(F.coalesce("reset", F.lit(0)), F.coalesce("anew", F.lit(0))).alias("reset")))
    # how many moves a part has before each of its frames
    before = F.count("*").over(Window.partitionBy("label").orderBy("frame")) - 1
    placed = moves.withColumn("nth", before).join(known.select("label", "old", "reset"), "label").withColumn("of", F.col("old") + F.col("nth"))
    one, other = (placed.select("frame", F.col("label").alias(x), F.col("reset").alias(f"reset_{x}"), F.col("of").alias(f"of_{x}")) for x in "ab")
    met = one.join(other, "frame").where("a < b AND frame >= greatest(reset_a, reset_b)").groupBy("a", "b").agg(F.count("*").alias("now"), F.min(F.struct("frame", "of_a", "of_b")).alias("first"))
    since = known.select(F.col("label").alias("a"), F.col("reset").alias("reset_a"))
    until = known.select(F.col("label").alias("b"), F.col("reset").alias("reset_b"))
    valid = pairs.join(since, "a").join(until, "b").where("began >= greatest(reset_a, reset_b)").drop("reset_a", "reset_b")
    both = valid.join(met, ["a", "b"], "full_outer")
    began = [F.coalesce(c, f"first.{f}").alias(c) for c, f in (("began", "frame"), ("of_a", "of_a"), ("of_b", "of_b"))]
    pairs = both.select("a", "b", began[0], (F.coalesce("both", F.lit(0)) + F.coalesce("now", F.lit(0))).alias("both"), *began[1:])
    return known.select("label", (F.col("old") + F.col("new")).alias("moves"), "reset"), pairs


def counters(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, cnt for a < b."""
    one, other = (parts.select(F.col("label").alias(x), F.col("moves").alias(f"moves_{x}")) for x in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", (3 * F.col("both") - (F.col("moves_a") - F.col("of_a")) - (F.col("moves_b") - F.col("of_b"))).alias("cnt"))


def folded(moves: DataFrame, resets: DataFrame, size: int) -> DataFrame:
    """Counters after blocks of `size` frames, one after another: as a stream gives them, over stored tables."""
    spark = moves.sparkSession
    moves, resets = cut(moves), cut(resets)
    parts, pairs = (spark.createDataFrame([], s) for s in SCHEMAS.values())
    block = F.floor(F.col("frame") / size).alias("block")
    for r in moves.select(block).union(resets.select(block)).distinct().orderBy("block").collect():  # a number for each block
        of = block == r.block
        parts, pairs = map(cut, step(parts, pairs, moves.where(of), resets.where(of)))
    return counters(parts, pairs)


def current(spark: SparkSession, path: str) -> DataFrame:
    """Counters as of the last commit of a stream that start() runs."""
    v = Versions(path, SCHEMAS)
    return counters(v.current(spark, "parts"), v.current(spark, "pairs"))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps counters of a stream of frame, label, moving (false: a reset) under path. A batch may hold several frames; rows of frames that were committed before are late and left out."""
    versions = Versions(path, SCHEMAS)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, frame = versions.last(spark, batch_id) or (None, None)
        rows = cut(batch if frame is None else batch.where(F.col("frame") > frame))
        last = rows.agg(F.max("frame")).first()[0]
        if last is None:
            return
        parts, pairs = step(versions.read(spark, "parts", version), versions.read(spark, "pairs", version), rows.where("moving"), rows.where("NOT moving"))
        versions.commit(spark, batch_id, last, {"parts": parts, "pairs": pairs})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
