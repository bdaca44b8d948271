"""Voxels kept from frame to frame: one step as a DataFrame function, folded over stored frames or run on a stream of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointfold.operators import spatial, surface
from pointfold.operators.cut import by_column, cut
from pointfold.streaming.versions import Versions

AT = ["kx", "ky", "kz"]
VALUES = list("xyzrgb")
SCHEMA = "kx long, ky long, kz long, " + ", ".join(f"{c} double, prev_{c} double" for c in VALUES) + ", first_frame long, seen_frame long, occluded_frame long, label long, changed boolean"
#: An occluder as near as this means that things came closer, not that the voxel is hidden; votes that a label needs.
TOO_NEAR, VOTES = 4, 3


def step(state: DataFrame, seen: DataFrame, frame: int, changed: Callable[[], Column] | None = None) -> DataFrame:
    """State after one frame of voxels (key, means).

    Old voxels (in the state) and new ones stand side by side while the frame is judged. New ones stay. Old ones with one
    neighbour or none go. Old ones that are seen are updated, their last means become prev_*, and are changed where
    changed(), over means and prev_*, says so. Old ones that aren't seen stay with their means if another voxel hides them
    from the camera, and occluded_frame is the first frame of that; but they go if that voxel is within TOO_NEAR, or if they
    have a new neighbour and that voxel isn't hidden since the same frame (0 if it is seen), as known before this frame.
    Given changed, labels are lost as in unlabelled(). A frame without voxels leaves the state as it is.
    """
    now = seen.select(*AT, *[F.col(c).cast("double").alias(f"now_{c}") for c in VALUES], F.lit(True).alias("here"))
    both = cut(state.join(now, AT, "full_outer").withColumns({"here": F.col("here").isNotNull(), "old": F.col("first_frame").isNotNull()}))
    at = F.lit(frame).cast("long")
    keyed = both.withColumn("frame", at)
    since = F.when(F.col("here"), 0).otherwise(F.coalesce("occluded_frame", F.lit(0)))
    hid = surface.occluders(keyed.where("old AND NOT here"), keyed.select(*spatial.KEY, (~F.col("old")).alias("is_new")))
    by = both.select(*[F.col(f"k{a}").alias(f"o{a}") for a in "xyz"], since.alias("other"))
    hid = hid.join(by, ["ox", "oy", "oz"]).select(*AT, "distance", "other")
    fresh = both.where("NOT old").select(*[F.col(f"k{a}").alias(f"n{a}") for a in "xyz"], F.lit(True).alias("fresh"))
    near = spatial.adjacency(keyed).join(fresh, ["nx", "ny", "nz"], "left").groupBy(*AT).agg(F.count("*").alias("near"), F.coalesce(F.bool_or("fresh"), F.lit(False)).alias("new_near"))
    all_ = both.join(hid, AT, "left").join(near, AT, "left")
    apart = F.coalesce("new_near", F.lit(False)) & (since != F.col("other"))
    stays = F.col("here") | ((F.col("distance") > TOO_NEAR) & ~apart)
    kept = all_.where(~F.col("old") | ((F.coalesce("near", F.lit(0)) > 1) & F.coalesce(stays, F.lit(False))))
    values = [e for c in VALUES for e in (F.coalesce(f"now_{c}", c).alias(c), F.col(c).alias(f"prev_{c}"))]
    frames = [F.coalesce("first_frame", at).alias("first_frame"), F.when(F.col("here"), at).otherwise(F.col("seen_frame")).alias("seen_frame"), F.when(F.col("here"), None).otherwise(F.coalesce("occluded_frame", at)).alias("occluded_frame")]
    new = kept.select(*AT, *values, *frames, "label", (F.col("here") & F.col("old")).alias("updated"))
    flag = F.coalesce(F.col("updated") & changed(), F.lit(False)) if changed else F.lit(False)
    new = cut(new.withColumn("changed", flag).drop("updated"))
    return unlabelled(new) if changed else new


def unlabelled(state: DataFrame) -> DataFrame:
    """state with labels lost: by changed voxels, and by all voxels of a label with fewer than VOTES votes, one for each unchanged voxel and one against for each changed one. One row a label is joined back."""
    votes = state.where("label IS NOT NULL").groupBy("label").agg(F.sum(F.when(F.col("changed"), -1).otherwise(1)).alias("votes"))
    both = state.join(votes, "label", "left")
    return both.withColumn("label", F.when(~F.col("changed") & (F.col("votes") >= VOTES), F.col("label"))).select(state.columns)


def fold(spark: SparkSession, voxels: DataFrame, frames: Iterable[int] | None = None, labels: DataFrame | None = None, changed: Callable[[], Column] | None = None) -> DataFrame:
    """State after the frames, in order (all that there are, if not given); labels (key, label) go to the voxels of the first. Frames depend on each other, so they run one after another; each is a distributed step. Voxels are written once by frame, so that a step reads its own only."""
    voxels, done = by_column(voxels, "frame")
    there = {r.frame for r in voxels.select("frame").distinct().collect()}  # a number for each frame
    state = spark.createDataFrame([], SCHEMA)
    for f in sorted(there if frames is None else there.intersection(frames)):
        state = step(state, voxels.where(F.col("frame") == f), f, changed)
        if labels is not None:
            state = state.drop("label").join(labels.select(*AT, F.col("label").cast("long").alias("label")), AT, "left").select(state.columns)
            labels = None
    state = cut(state)
    done()
    return state


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state as of the last commit of a stream that start() runs."""
    return Versions(path, {"state": SCHEMA}).current(spark, "state")


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of points into state under path. Frames are numbers in the data: a batch may hold several, an empty one changes nothing, and rows of frames that were committed before are late and left out. A frame comes whole in one batch."""
    versions = Versions(path, {"state": SCHEMA})

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, last = versions.last(spark, batch_id) or (None, None)
        seen = cut(spatial.voxels(spatial.crop(batch if last is None else batch.where(F.col("frame") > last))))
        frames = [r.frame for r in seen.select("frame").distinct().orderBy("frame").collect()]  # those of one batch
        if not frames:
            return
        state = versions.read(spark, "state", version)
        for f in frames:
            state = step(state, seen.where(F.col("frame") == f).drop("frame"), f)
        versions.commit(spark, batch_id, frames[-1], {"state": state})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
