"""Point clouds as lines of text: a header of named fields, then a point on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that begin the lines of a header.
HEADER = ("#", "VERSION", "FIELDS", "SIZE", "TYPE", "COUNT", "WIDTH", "HEIGHT", "VIEWPOINT", "POINTS", "DATA")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the lines of all clouds below path; files are split, so a large cloud spreads over tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def parsed(rows: DataFrame, fields: list[str]) -> DataFrame:
    """file and the fields, as doubles, of each point; each file may have its fields in an order of its own (one row a file is joined back), and a field that a file lacks is null, as is one that is nan."""
    rows = rows.withColumn("value", F.trim("value")).where("value <> ''")
    first = F.split("value", r"\s+")
    order = rows.where(first[0] == "FIELDS").groupBy("file").agg(F.min(F.slice(first, 2, F.size(first) - 1)).alias("fields"))
    data = rows.where(~first[0].isin(*HEADER) & ~first[0].startswith("#")).select("file", first.alias("cells")).join(F.broadcast(order), "file")
    at = lambda f: F.try_element_at("cells", F.array_position("fields", f).cast("int"))
    number = lambda f: F.when(F.array_position("fields", f) > 0, F.nanvl(at(f).try_cast("double"), F.lit(None)))
    return data.select("file", *[number(f).alias(f) for f in fields])
