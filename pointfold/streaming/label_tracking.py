"""The particle filters of operators.tracker over a stream, their state kept by label.

A stream has rows of three kinds, ordered by frame: the reference points of a label, which begin its filter or replace it; points of the
scene; and deletions of a label. Each label's filter is a value in Spark's state store, so a restart goes on where it
was, a deleted label doesn't come back, and state can be read by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pointfold.operators.tracker import REACH, RESULT, VALUES, Tracker, regions, result, routed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns of the stream; kind is reference, point or delete, and points have no label yet.
INPUT = "kind string, label long, frame long, " + ", ".join(f"{v} double" for v in VALUES)
STATE = "frame long, pose array<double>, motion array<double>, reference binary, particles binary, weights binary"
KINDS = {"delete": 0, "reference": 1, "point": 2}


class Trackers(StatefulProcessor):
    """One filter for each label. Of the frames of a batch each is a step, in order; frames that are not after the last one are late and left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracker", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch["order"] = batch["kind"].map(KINDS)
        tracker = self._held(key[0])
        changed = False
        for (frame, order), part in batch.groupby(["frame", "order"], sort=True):
            values = part[VALUES].to_numpy(float)
            if order == KINDS["delete"]:
                tracker, changed = None, True
            elif order == KINDS["reference"]:
                tracker, changed = Tracker.begin(key[0], values, int(frame)), True
            elif tracker is not None and frame > tracker.frame:
                tracker, changed = tracker.follow(values, int(frame)), True
                yield result(tracker)
        if tracker is None:
            self.state.clear()
        elif changed:
            self.state.update((tracker.frame, tracker.pose.tolist(), tracker.motion.tolist(), tracker.reference.tobytes(), tracker.particles.tobytes(), tracker.weights.tobytes()))

    def _held(self, label: int) -> Tracker | None:
        if not self.state.exists():
            return None
        frame, pose, motion, *arrays = self.state.get()
        reference, particles, weights = (np.frombuffer(bytes(a)) for a in arrays)
        return Tracker(label, reference.reshape(-1, 6), np.array(pose), np.array(motion), particles.reshape(-1, 6), weights, int(frame))

    def close(self) -> None:
        pass


def poses(stream: DataFrame, places: DataFrame, reach: int = REACH) -> DataFrame:
    """A stream of poses from a stream of INPUT. places: reference points of all labels that may come (label, x, y, z), by which points go to labels."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    points = routed(stream.where("kind = 'point'").drop("label"), regions(places, reach), reach)
    rows = stream.where("kind <> 'point'").unionByName(points)
    return rows.groupBy("label").transformWithStateInPandas(Trackers(), RESULT, "Append", "none")


def start(stream: DataFrame, places: DataFrame, path: str, checkpoint: str, reach: int = REACH) -> StreamingQuery:
    """Runs poses() into Parquet files under path until all that is there is read."""
    out = poses(stream, places, reach).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()


def held(spark: SparkSession, checkpoint: str, label: int | None = None) -> DataFrame:
    """label, frame, pose and number of particles of the filters in the state store; of one label, if given."""
    state = spark.read.format("statestore").option("stateVarName", "tracker").load(checkpoint)
    rows = state.select(F.col("key.label").alias("label"), "value.frame", "value.pose", (F.octet_length("value.weights") / 8).cast("int").alias("particles"))
    return rows if label is None else rows.where(F.col("label") == label)


def deletion(spark: SparkSession, label: int, frame: int) -> DataFrame:
    """The row that deletes a label from that frame on, to be added to the stream's source."""
    return spark.createDataFrame([("delete", label, frame, *[None] * len(VALUES))], INPUT)
