"""Where equal windows (of bytes or words) can be: winnowed anchors and their contexts.

Every window of `length` symbols chooses one of its k-grams as its anchor, by content only, so equal windows
choose the same gram at the same offset. An anchor's context is the stretch of all windows that chose it. One place
of each context stands for all of them, with their number; contexts that occur once and share their anchor with no
other hold no repeat. The rest is cut out of the texts and compared anchor by anchor (decided), and what is found
for a context holds at all its places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointfold.llm.common import grams, in_batches, partitions, written

#: copies: rows with this doc and text; first: the smallest window start (bytes) that chose the anchor; size: of the context in bytes; d0..d1: anchor minus window start; pos: of the anchor. pos, d0 and d1 count symbols.
PLACE = "h long, c long, doc long, key long, copies long, pos int, d0 int, d1 int, first int, size int"
#: Symbols of a text's bytes, as hashes, where each starts and where it ends.
Symbols = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def canonical(symbols: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: position, first and last window start that chose it."""
    w, step, parts = length - k + 1, 1 << 22, []
    total = len(symbols) - length + 1
    for lo in range(0, max(total, 0), step):
        h = grams(symbols[lo : lo + step + length - 1], k)
        m = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        s = 1
        while 2 * s <= w:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        m = np.minimum(m[: len(m) - (w - s)], m[w - s :])
        parts.append((m & np.uint64(0xFFFFFF)).astype(np.int64) + lo)
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    p = np.concatenate(parts)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return p[first], first, np.append(first[1:], len(p)) - 1


def places(docs: DataFrame, length: int, k: int, symbols: Symbols) -> DataFrame:
    """A row for each anchor of each document of keyed(), repeated rows once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(10)]
            for doc, key, copies, text in zip(batch["doc"].to_pylist(), batch["key"].to_pylist(), batch["copies"].to_pylist(), batch["text"], strict=True):
                sym, starts, ends = symbols(raw_bytes(text))
                if len(sym) < length:
                    continue
                p, a, b = canonical(sym, length, k)
                raw = memoryview(np.ascontiguousarray(sym)).cast("B")
                z = sym.itemsize
                h = [xxhash.xxh3_64_intdigest(raw[z * x : z * (x + k)]) for x in p.tolist()]
                c = [xxhash.xxh3_64_intdigest(raw[z * x : z * (y + length)], q - x) for x, y, q in zip(a.tolist(), b.tolist(), p.tolist(), strict=True)]
                first = starts[a]
                for to, x in zip(cols, (np.array(h, np.uint64).view(np.int64), np.array(c, np.uint64).view(np.int64), np.full(len(p), doc), np.full(len(p), key), np.full(len(p), copies), p, p - b, p - a, first, ends[b + length - 1] - first), strict=True):
                    to.append(x)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)).cast(t) for x, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PLACE.split(", ")])

    return in_batches(docs.where("copy = 1").select("doc", "key", "copies", "text"), scan, PLACE)


def raw_bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)


def keyed(docs: DataFrame) -> DataFrame:
    """doc (a null id comes after all others), key (equal rows share it), text, doc_id, copy (a number from 1 among equal rows) and copies (how many there are); dealt by document, once, for all joins."""
    df = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
    same = Window.partitionBy("doc", "key")
    df = df.repartition(partitions(docs.sparkSession), "doc", "key")
    return df.withColumn("copy", F.row_number().over(same.orderBy(F.lit(0)))).withColumn("copies", F.count("*").over(same))


def contexts(all_places: DataFrame) -> DataFrame:
    """Of the written places: the contexts that may hold repeats (h, c, n: rows, k: distinct contexts of the anchor, low and high: the smallest and largest doc, and a place of the smallest), those with n > 1 or k > 1. Counts are combined before rows move, so a frequent context costs a row for each task."""
    one = all_places.groupBy("h", "c").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"), F.min(F.struct("doc", "key", "pos", "d0", "d1", "first", "size")).alias("rep"), F.max("doc").alias("high"))
    one = one.select("h", "c", "n", "rows", F.col("rep.doc").alias("low"), "high", "rep.*")
    of_anchor = one.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("all")).where("`all` > 1").drop("all")
    return written(one.join(of_anchor, "h"), "contexts")


def fetched(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """h, c, k, n, low, high, d0, d1 and the bytes of each context, cut out where the document is."""
    joined = wanted.join(docs.where("copy = 1").select("doc", "key", "text"), ["doc", "key"])
    return joined.select("h", "c", "k", "n", "low", "high", "d0", "d1", F.expr("substring(cast(text AS binary), first + 1, size)").alias("bytes"))


PIECE = ["h", "c", "k", "n", "low", "high", "d0", "d1", "bytes"]


def decided(pieces: DataFrame, compare: Callable[[Iterator[list[dict]]], Iterator[tuple]], schema: str, length: int, symbols: Symbols, widths: tuple[int, ...], most: int) -> DataFrame:
    """Rows of schema (h, c, ..., lo, hi), made by compare from lists of whole groups of one h.

    A group of more than `most` pieces doesn't go to one task: its pieces are cut into those of `width` windows each, which
    group anew by what their windows share, and so on to single windows; equal ones count as one.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_groups(batches, "h", 8_000_000, "bytes"):
            out = list(compare(rows))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    n = partitions(pieces.sparkSession)
    pieces = pieces.select(*PIECE)
    found = in_batches(pieces.where(F.col("k") <= most).repartition(n, "h").sortWithinPartitions("h", "c"), each, schema)
    large = pieces.where(F.col("k") > most)
    if not widths or not large.limit(1).count():
        return found
    width = widths[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw, top = r["bytes"], r["d1"]
                sym, starts, ends = symbols(np.frombuffer(raw, np.uint8))
                for q in range(r["d0"] // width, r["d1"] // width + 1):
                    lo, hi = max(r["d0"], q * width), min(r["d1"], q * width + width - 1)
                    core = np.ascontiguousarray(sym[top - q * width : max(top - q * width - width + 1 + length, top - q * width)]).tobytes()
                    piece = raw[starts[top - hi] : ends[top - lo + length - 1]]
                    h = xxhash.xxh3_64_intdigest(core, (r["h"] + q * 0x9E3779B97F4A7C15) & (2**64 - 1))
                    out.append((r["h"], r["c"], signed(h), signed(xxhash.xxh3_64_intdigest(piece, hi - q * width)), r["n"], r["low"], r["high"], lo, hi, piece))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()])], names=["of_h", "of_c", *(x for x in PIECE if x != "k")])

    finer = written(in_batches(large, cut, "of_h long, of_c long, h long, c long, n long, low long, high long, d0 int, d1 int, bytes binary"), "finer")
    one = finer.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.first(x).alias(x) for x in ("d0", "d1", "bytes")])
    of_core = finer.groupBy("h").agg(F.countDistinct("c").alias("k"), F.sum("n").alias("all")).where("`all` > 1").drop("all")
    got = decided(one.join(of_core, "h"), compare, schema, length, symbols, widths[1:], most if widths[1:] else 2**62)
    back = finer.select("h", "c", "of_h", "of_c").join(got, ["h", "c"]).drop("h", "c").withColumnsRenamed({"of_h": "h", "of_c": "c"})
    return found.unionByName(back)


def in_groups(batches: Iterator[pa.RecordBatch], column: str, limit: int, weight: str) -> Iterator[list[dict]]:
    """Rows sorted by `column`, in lists of whole groups that hold about `limit` bytes of `weight`."""
    rows: list[dict] = []
    size, last = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if size >= limit and row[column] != last:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += len(row[weight])
            last = row[column]
    if rows:
        yield rows


def at_places(all_places: DataFrame, one: DataFrame, ranges: DataFrame) -> DataFrame:
    """The places of each context with what was found for it. A context with many places is dealt over several tasks: at most four times as many as partitions can be so frequent, so their list is small enough to send to all."""
    share = max(all_places.count() // (4 * partitions(all_places.sparkSession)), 1000)
    often = F.broadcast(one.where(F.col("rows") > share).select("h", "c", F.ceil(F.col("rows") / share).cast("int").alias("tasks")))
    tasks = F.coalesce("tasks", F.lit(1))
    left = all_places.join(often, ["h", "c"], "left").withColumn("task", F.pmod(F.xxhash64("doc", "pos"), tasks).cast("int")).drop("tasks")
    right = ranges.join(often, ["h", "c"], "left").withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks")
    return left.join(right, ["h", "c", "task"])


def spans_by_document(spans: DataFrame) -> DataFrame:
    """doc, key, spans: array of distinct (a, b), not merged yet; in number the document's anchors, and the pieces that they are found in."""
    return spans.groupBy("doc", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]
