"""A report of labels by frame: a header, then a line for each frame, its labels each with a semicolon and their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "lost_labels,total,"


def lines(labels: DataFrame) -> DataFrame:
    """frame, line of labels (frame, label), in no order; the header has frame -1. The labels of one frame come together."""
    g = labels.groupBy("frame").agg(F.sort_array(F.collect_list("label")).alias("l"))
    rows = g.select("frame", F.concat(F.array_join(F.transform("l", lambda x: F.concat(x.cast("string"), F.lit(";"))), ""), F.lit(","), F.size("l"), F.lit(",")).alias("line"))
    return rows.unionByName(labels.sparkSession.createDataFrame([(-1, HEADER)], "frame long, line string"))


def save(labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes the lines under path, in order of frames from file to file, the header first. Ranges of frames are written side by side."""
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines(labels).repartitionByRange(parts, "frame").sortWithinPartitions("frame").select("line").write.mode(mode).text(path)
