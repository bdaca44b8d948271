"""State of a stream as tables with versions: each batch writes its own and then a commit, so a batch that runs again begins where it began before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch long, frame long, version long"


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Versions:
    """Tables by name under path, with the schemas given; a version of them for each batch that changed them, the last two of which stay."""

    def __init__(self, path: str, schemas: dict[str, str]) -> None:
        self.path, self.schemas = path.rstrip("/"), schemas

    def _commits(self, spark: SparkSession) -> DataFrame:
        fs, p = _path(spark, f"{self.path}/commits")
        if not fs.exists(p):
            return spark.createDataFrame([], COMMIT)
        return spark.read.schema(COMMIT).parquet(f"{self.path}/commits/*")

    def last(self, spark: SparkSession, before: int | None = None) -> tuple[int, int] | None:
        """Version and frame of the last commit, of a batch before that one if given."""
        rows = self._commits(spark)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        r = rows.orderBy(F.col("batch").desc()).first()
        return (r.version, r.frame) if r else None

    def read(self, spark: SparkSession, name: str, version: int | None) -> DataFrame:
        if version is None:
            return spark.createDataFrame([], self.schemas[name])
        return spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}/version={version}")

    def current(self, spark: SparkSession, name: str) -> DataFrame:
        """The table as of the last commit."""
        at = self.last(spark)
        return self.read(spark, name, at[0] if at else None)

    def commit(self, spark: SparkSession, batch: int, frame: int, tables: dict[str, DataFrame]) -> None:
        """Writes the tables as this batch's version; the commit, one row, makes it count. Versions before the one it began with go."""
        before = self.last(spark, batch)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={batch}")
        spark.createDataFrame([(batch, frame, batch)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch:012d}")
        old = self.last(spark, before[0]) if before else None
        if old:
            for name in tables:
                fs, p = _path(spark, f"{self.path}/{name}/version={old[0]}")
                fs.delete(p, True)
            fs, p = _path(spark, f"{self.path}/commits/batch={old[0]:012d}")
            fs.delete(p, True)
