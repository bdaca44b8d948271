"""Parts that move together: counters in closed form, and objects as connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointfold.operators.components import connected
from pointfold.operators.cut import cut

#: Frames whose moves of one part are ranked together.
FRAMES = 10_000


def since_reset(moves: DataFrame, resets: DataFrame) -> DataFrame:
    """Moves of a part at or after its last reset, with that frame."""
    last = resets.groupBy("label").agg(F.max("frame").alias("reset"))
    return moves.join(last, "label", "left").withColumn("reset", F.coalesce("reset", F.lit(0)))


def with_later(moves: DataFrame, frames: int = FRAMES) -> DataFrame:
    """Adds later: how many of the part's moves are in this frame or after it. Blocks of frames are counted first, so that only a number for each block of a part's history comes together."""
    block = F.floor(F.col("frame") / frames).alias("block")
    sizes = moves.groupBy("label", block).agg(F.count("*").alias("n"))
    after = sizes.select("label", "block", (F.sum("n").over(Window.partitionBy("label").orderBy(F.col("block").desc())) - F.col("n")).alias("after"))
    own: Column = F.count("*").over(Window.partitionBy("label", "block").orderBy(F.col("frame").desc()))
    return moves.withColumn("block", block).join(after, ["label", "block"]).withColumn("later", own + F.col("after")).drop("block", "after")


def counters(moves: DataFrame, resets: DataFrame) -> DataFrame:
    """a, b, cnt for a < b: from the first frame after both resets in which both move, +1 for each frame in which both do and -1 for each in which one does.

    Both counts of one part's later frames are looked up at that first frame, so no pair is joined with all frames.
    """
    m = with_later(since_reset(moves, resets))
    a = m.select("frame", F.col("label").alias("a"), F.col("reset").alias("ra"), F.col("later").alias("la"))
    b = m.select("frame", F.col("label").alias("b"), F.col("reset").alias("rb"), F.col("later").alias("lb"))
    both = a.join(b, "frame").where("a < b AND frame >= greatest(ra, rb)")
    first = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("frame", "la", "lb")).alias("f"))
    return first.select("a", "b", (3 * F.col("n") - F.col("f.la") - F.col("f.lb")).alias("cnt"))


def objects(moves: DataFrame, resets: DataFrame) -> DataFrame:
    """object_id (its least part) and part, over pairs with a positive counter; parts without one are objects of their own."""
    parts = since_reset(moves, resets).where("frame >= reset").select(F.col("label").alias("part")).distinct()
    root = connected(counters(moves, resets).where("cnt > 0").select("a", "b"))
    return parts.join(root, parts.part == root.node, "left").select(F.coalesce("root", "part").alias("object_id"), "part")


def first_independent(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node of those that taking nodes in order, and leaving out each that is linked (a, b) to one taken before, would take.

    A round settles every node whose smaller neighbours are settled: left out if one of them is taken, else taken. Rounds are written out.
    """
    smaller = cut(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).where("node <> other").distinct())
    known = cut(nodes.select("node", F.lit(None).cast("boolean").alias("taken")).distinct())
    while known.where("taken IS NULL").limit(1).count():
        of = smaller.join(known.select(F.col("node").alias("other"), F.col("taken").alias("there")), "other")
        seen = of.groupBy("node").agg(F.coalesce(F.bool_or("there"), F.lit(False)).alias("near"), F.bool_and(F.col("there").isNotNull()).alias("ready"))
        both = known.join(seen, "node", "left")
        now = F.when(F.col("near"), False).when(F.coalesce("ready", F.lit(True)), True)
        known = cut(both.select("node", F.coalesce("taken", now).alias("taken")))
    return known.where("taken").select("node")


def greedy_objects(moves: DataFrame, resets: DataFrame) -> DataFrame:
    """As greedy_groups(), of parts that move together."""
    parts = since_reset(moves, resets).where("frame >= reset").select(F.col("label").alias("node")).distinct()
    return greedy_groups(counters(moves, resets).where("cnt > 0").select("a", "b"), parts)


def greedy_groups(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """object_id and part of parts (node) and pairs of them (a, b), as one part after another finds them, instead of components: a part may be in several objects, and a chain of parts in more than one.

    The smallest free part is the centre of a star with all its partners, which are free no more; and so on. Then one pass over the stars in order
    merges into each all that share a part with it as it was at first. Of stars that overlap the first takes the others, so those that are left are
    again the ones taken in order; each star goes to the first of them that it overlaps; and a star that is left joins an earlier one where it
    overlaps what that one took. object_id is the centre of the last star of a group.
    """
    pairs, parts = cut(pairs.select("a", "b")), cut(parts.select("node").distinct())
    centres = first_independent(pairs, parts)
    partners = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("part"))
    stars = cut(centres.join(partners, "node").unionByName(centres.select("node", F.col("node").alias("part"))).select(F.col("node").alias("star"), "part"))
    other = stars.select(F.col("star").alias("other"), "part")
    overlaps = cut(stars.join(other, "part").where("star < other").select(F.col("star").alias("a"), F.col("other").alias("b")).distinct())
    left = first_independent(overlaps, centres).select(F.col("node").alias("star"))
    taken = overlaps.join(left, overlaps.a == left.star, "left_semi").groupBy(F.col("b").alias("star")).agg(F.min("a").alias("by"))
    owner = cut(left.select("star", F.col("star").alias("by")).unionByName(taken.join(left, "star", "left_anti")))
    held = stars.join(owner, "star").select("by", "part").distinct()
    reach = stars.join(left, "star", "left_semi").join(held.withColumnRenamed("by", "a"), "part").where("a < star").select("a", F.col("star").alias("b")).distinct()
    root = connected(reach)
    group = held.join(root, held.by == root.node, "left").select(F.coalesce("root", "by").alias("root"), "by", "part")
    last = group.groupBy("root").agg(F.max("by").alias("object_id"))
    return group.join(last, "root").select("object_id", "part").distinct()
