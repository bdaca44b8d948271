"""What the text operators share: written tables, word and gram hashes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of other characters than these six (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
ODD = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where it is unset and all run in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":  # not local-cluster
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pointfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The application's own folder within the shared one."""
    return f"{shared_dir(spark)}/pointfold-{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Removes the tables that written() has made in this application. Call it when all results are saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors. Results read such tables until they are written out themselves; then drop_written removes them all."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at a time, where the session doesn't say: by rows alone, a batch of long texts has no bound.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of bounded size; a task's worker, which later tasks use again, gives back what Arrow holds. Where the session sets no bound of bytes for Arrow, BATCH_BYTES becomes the session's bound: Spark reads it when the query starts, so it can't be set back here."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(lean, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of each hash spread evenly (in place)."""
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols (uint64) from each position on; k is a power of two."""
    h, s, level = symbols, 1, 0
    while s < k:
        h = h[:-s] * ODD[level] + h[s:]
        s, level = 2 * s, level + 1
    return mixed(h.copy() if h is symbols else h)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2**64."""
    global _POW
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        p, q = int(ODD[60]), pow(int(ODD[60]), -1, 2**64)
        _POW = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (p, q))
    return _POW[0][:n], _POW[1][:n]


_POW: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of the UTF-8 bytes, without a loop over words."""
    starts, ends = word_bounds(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(TABLE[buf] * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)

