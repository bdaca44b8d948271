"""Operator 3: lines that many documents share, dropped by per-document bitmaps.

Result for odd input: null or empty text is one empty line, which has no key and stays; documents are counted by
doc_id (null is an id of its own), so repeated rows count once and lose the same lines; other columns pass
through unchanged; an empty table gives an empty result.
"""

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.llm.common import in_batches, partitions, table, written

BLANKS = "\x20\t\n\x0b\f\r"
#: Rows of one run that a task holds back before it passes them on, to be settled by the count over all tasks.
HELD_MOST = 50_000
RUNS = "h1 long, h2 long, doc long, key long, pos int, first boolean, edge boolean"


def hashed_lines(docs: DataFrame) -> DataFrame:
    """h1, h2 (128 bits of the line's key), doc, key, pos: a row for each line that has a key."""
    key = F.translate(F.trim(F.col("line"), F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)
    lines = docs.select("doc", "key", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.select("doc", "key", "pos", key.alias("line")).where("line <> ''")
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "doc", "key", "pos")


def common_runs(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines dealt by range of (hash, document), so that a very common line spreads over many tasks, sorted and streamed: a run of one hash is kept from the task's first to last document once it has min_docs of them. Runs at a task's edges may go on in the next, so they are kept whole and marked."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.bool_()]
        names = [x.split()[0] for x in RUNS.split(", ")]
        held: list[np.ndarray] = []  # the last run so far
        before = None  # the row that came before the held run, if the run's first part is out already
        at_edge = True  # the held run began before this task, or a part of it is out

        def out(cols: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, edge], kinds, strict=True)], names=names)

        for batch in batches:
            cols = [batch[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "key", "pos")]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            h1, h2, doc = cols[:3]
            if not len(h1):
                continue
            new_run, first = np.ones(len(h1), bool), np.ones(len(h1), bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first[1:] = new_run[1:] | (doc[1:] != doc[:-1])
            first[0] = before != (h1[0], h2[0], doc[0])
            starts = np.flatnonzero(new_run)
            docs = np.add.reduceat(first.astype(np.int64), starts)
            last, sizes = starts[-1], np.diff(np.append(starts, len(h1)))
            edge = np.zeros(len(starts), bool)
            edge[0] = at_edge
            keep = (docs >= min_docs) | edge
            keep[-1] = sizes[-1] > HELD_MOST
            edge[-1] |= keep[-1]
            if keep.any():
                rows = np.repeat(keep, sizes)
                yield out([c[rows] for c in (*cols, first)], np.repeat(edge, sizes)[rows])
            if keep[-1]:
                before, at_edge, held = (h1[-1], h2[-1], doc[-1]), True, []
            else:
                if len(starts) > 1:
                    before, at_edge = None, False
                held = [c[last:] for c in cols]
        if held:
            first = np.ones(len(held[0]), bool)
            first[1:] = held[2][1:] != held[2][:-1]
            first[0] = before != (held[0][0], held[1][0], held[2][0])
            yield out([*held, first], np.ones(len(first), bool))

    n = partitions(lines.sparkSession)
    dealt = lines.repartitionByRange(n, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "key", "pos")
    return in_batches(dealt, stream, RUNS)


def dropped_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """doc, key, drop: positions of the lines that go."""
    runs = written(common_runs(hashed_lines(docs), min_docs), "runs")
    # at most two hashes for each task of the range partitioning, so this side is small
    wide = runs.where("edge").groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("docs")).where(F.col("docs") >= min_docs)
    rows = runs.where("NOT edge").select("doc", "key", "pos").union(runs.where("edge").join(F.broadcast(wide), ["h1", "h2"], "left_semi").select("doc", "key", "pos"))
    return rows.groupBy("doc", "key").agg(F.collect_set("pos").alias("drop"))


def bitmap(n: int, drop: list[int] | None) -> bytes:
    """A bit for each line, 1 where it stays, compressed."""
    bits = np.ones(n, bool)
    bits[drop or []] = False
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def kept_lines(text: str | None, keep: bytes) -> str:
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    return "\n".join(x for x, k in zip(lines, bits.tolist(), strict=True) if k)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, cut: bool = False) -> DataFrame:
    """row (the columns of docs), n_lines, n_dropped, keep (see bitmap), and kept: null, or with cut the lines that stay, where any goes; cut where the bitmap is made, so that texts go to Python once. Lines whose key, the line without blanks around and in lower case, is in at least min_docs documents go from all of them."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
    joined = keyed.join(dropped_lines(keyed.select("doc", "key", "text"), min_docs), ["doc", "key"], "left")
    joined = joined.select("row", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), "drop")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drops = b["drop"].to_pylist()
            keep = [bitmap(n, d) for n, d in zip(b["n_lines"].to_pylist(), drops, strict=True)]
            gone = pa.array([len(d or ()) for d in drops], pa.int64())
            kept = [kept_lines(t.as_py(), k) if cut and d else None for t, k, d in zip(b["row"].field("text"), keep, drops, strict=True)]
            yield pa.RecordBatch.from_arrays([b["row"], b["n_lines"], gone, pa.array(keep, pa.binary()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "keep", "kept"])

    kind = joined.schema["row"].dataType.simpleString()
    return in_batches(joined, pack, f"row {kind}, n_lines long, n_dropped long, keep binary, kept string")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, counts: bool = True) -> DataFrame:
    """The columns of docs with text as it is after the drop (n_chars, if there, too), and with counts: __lines, __dropped."""
    maps = keep_bitmaps(docs, min_docs, cut=True)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return maps.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns], *([F.col("n_lines").alias("__lines"), F.col("n_dropped").alias("__dropped")] if counts else []))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""


def brute_force(rows: list[tuple[int | None, str | None]], min_docs: int) -> list[tuple[int, int, str]]:
    """For tests: n_lines, n_dropped, kept_sha256 of each (doc_id, text)."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    key = lambda x: x.strip(BLANKS).translate(lower)
    held: dict[str, set] = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x):
                held.setdefault(key(x), set()).add(i)
    out = []
    for _, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < min_docs]
        out.append((len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out
