"""Operator 1: exact repeats of byte strings, by suffix arrays of shards of candidate text.

Candidates are the stretches around winnowed anchors that occur more than once (repeats.py), one of each distinct
stretch, and twice if it has several places, so that the arrays find its windows equal like any others. Suffix arrays of
shards of them, by Larsson-Sadakane refinement to the window's length, give the classes of equal windows: the suffixes still tied; a group of stretches
that needs several shards has their classes merged by binary search. A window is repeated where its class has more than one.

Result for odd input: null text counts as empty; texts shorter than the window keep everything; rows that
repeat (same doc_id and text) are documents of their own, so their texts repeat each other; rows that share only
a doc_id are separate documents; other columns of `docs` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.llm import suffix
from pointfold.llm.common import TABLE, in_batches, table, written
from pointfold.llm.repeats import at_places, contexts, decided, fetched, keyed, merged, places, spans_by_document

#: Bytes of one suffix array's text; a larger group has several and is merged by binary search.
SHARD_BYTES = 1_000_000
#: Contexts of one anchor that go to one task; more are grouped anew by what fewer windows share.
GROUP_MOST = 16_384
WIDTHS = (32, 1)


def byte_symbols(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(buf))
    return TABLE[buf], at, at + 1


class Pieces:
    """Stretches of one anchor: text, and the row and largest d of its first window (no row for a second copy)."""

    def __init__(self) -> None:
        self.rows: list[tuple[int | None, int]] = []
        self.text: list[bytes] = []


def by_anchor(rows: list[dict]) -> list[Pieces]:
    out: dict[int, Pieces] = {}
    for i, r in enumerate(rows):
        p = out.setdefault(r["h"], Pieces())
        for copy in range(min(r["n"], 2)):
            p.rows.append((None if copy else i, r["d1"]))
            p.text.append(r["bytes"])
    return list(out.values())


class Shard:
    """A suffix array over pieces; classes of equal windows are the suffixes that stay tied at their length."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(x) for x in texts])
        self.base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        piece = np.repeat(np.arange(len(texts)), sizes)
        past = np.maximum(np.arange(len(self.text)) - (self.base + sizes - length)[piece], 0)
        valid = past == 0
        sa, tied = suffix.suffix_array(self.text, length, past)
        cls = np.cumsum(~tied)  # tied: `length` bytes are shared, so no common prefixes are needed
        keep = valid[sa]
        self.starts, self.cls, self.piece = sa[keep], cls[keep], piece[sa[keep]]
        new = np.ones(len(self.starts), bool)
        new[1:] = np.diff(self.cls) != 0
        self.cls = np.cumsum(new) - 1
        self.heads = self.starts[new]  # sorted: one suffix of each class, for the binary search
        self.weight = np.bincount(self.cls)

    def meet(self, other: Shard, length: int) -> None:
        """Numbers of the windows that both shards hold, added up in both."""
        slot = suffix.find(self.text, self.heads, other.text, other.heads, length)
        here, there = slot[slot >= 0], np.flatnonzero(slot >= 0)
        a, b = self.own[here], other.own[there]
        self.weight[here] += b
        other.weight[there] += a

    def seal(self) -> None:
        self.own = self.weight.copy()


def repeated_windows(pieces: list[Pieces], length: int, shard_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(row, d low, d high) of windows that recur. Groups of one anchor are never compared with others; small ones share a shard."""

    def parts() -> Iterator[list[tuple[list, list]]]:
        room: tuple[list, list] = ([], [])
        size = 0
        for p in pieces:
            total = sum(map(len, p.text))
            if total > shard_bytes:
                cuts = np.cumsum([len(x) for x in p.text]) // shard_bytes
                ends = [*np.flatnonzero(np.diff(cuts)) + 1, len(cuts)]
                yield [(p.rows[a:b], p.text[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                continue
            if size + total > shard_bytes:
                yield [room]
                room, size = ([], []), 0
            for to, x in zip(room, (p.rows, p.text), strict=True):
                to += x
            size += total
        if room[0]:
            yield [room]

    for group in parts():
        shards = [Shard(t, length) for _, t in group]
        for s in shards:
            s.seal()
        for j, s in enumerate(shards):
            for earlier in shards[:j]:
                earlier.meet(s, length)
        for s, (rows, _) in zip(shards, group, strict=True):
            hit = s.weight[s.cls] > 1
            at = np.sort(s.starts[hit])
            piece = np.searchsorted(s.base, at, side="right") - 1
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(piece) != 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            for a, b, p in zip(at[first].tolist(), at[last].tolist(), piece[first].tolist(), strict=True):
                i, hi = rows[p]
                if i is None:
                    continue
                base = int(s.base[p])
                yield i, hi - (b - base), hi - (a - base)


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 32, shard_bytes: int = SHARD_BYTES, group_most: int = GROUP_MOST, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """docs: as keyed() gives them. Rows doc, key, a, b: byte spans whose windows of `length` bytes also start elsewhere."""
    at = written(places(docs, length, gram, byte_symbols), "places")
    one = contexts(at)

    def compare(rows: list[dict]) -> Iterator[tuple]:
        for i, lo, hi in repeated_windows(by_anchor(rows), length, shard_bytes):
            yield rows[i]["h"], rows[i]["c"], lo, hi

    ranges = decided(fetched(one, docs), compare, "h long, c long, lo int, hi int", length, byte_symbols, widths, group_most)
    hit = at_places(at, one, ranges)
    return hit.select("doc", "key", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + length).alias("b"))


def remove_repeats(docs: DataFrame, length: int = 400, **kwargs: object) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte offsets of the maximal removed runs), kept (binary: the bytes that remain)."""
    docs = keyed(docs)
    spans = spans_by_document(repeated_spans(docs, length, **kwargs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch["spans"].to_pylist(), strict=True):
                raw = bytes(text.as_buffer()) if text.is_valid else b""
                runs, kept, last = merged(spans), [], 0
                for a, b in runs:
                    kept.append(raw[last:a])
                    last = b
                kept.append(raw[last:])
                whole = b"".join(kept)
                rows.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(whole), "n_spans": len(runs), "spans": [{"a": a, "b": b} for a, b in runs], "kept": whole})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("kept", pa.binary())]))

    whole = docs.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans")
    return in_batches(whole, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<a:int,b:int>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """For tests: n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = defaultdict(int)
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] += 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(raw, gone[1:-1], strict=True) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
