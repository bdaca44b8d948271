"""Operator 4: repeats of word sequences, by relative Lempel-Ziv parsing against reference blocks of earlier documents.

Stretches around winnowed anchors that occur more than once (repeats.py) are parsed anchor by anchor, one of each
distinct stretch: that of its smallest document, indexed in reference blocks, and once more for all its later documents.
Every stretch is factored greedily against each block of smaller documents. As factors are the longest possible, a
window that a block holds lies in one factor or crosses one boundary, so long factors and the boundaries between factors
that are long enough together find them all. Nothing is removed that no parse found.

Result for odd input: null or blank text has no words; texts shorter than the window keep all words; rows that
share a doc_id are neither's predecessor, so they keep what only they share; a null doc_id counts as the largest;
other columns of `docs` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.llm.common import in_batches, table, word_bounds, word_hashes, written
from pointfold.llm.repeats import at_places, contexts, decided, fetched, keyed, merged, places, spans_by_document

#: Stretches that one reference block indexes; a group's stretches are parsed against each of its blocks.
BLOCK = 512
#: Stretches of one anchor that go to one task; more are grouped anew by what fewer windows share.
GROUP_MOST = 8_192
WIDTHS = (8, 1)


def word_symbols(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_hashes(buf), *word_bounds(buf)


class ReferenceBlock:
    """Every factor of the indexed texts, as an automaton over words that grows one text at a time."""

    def __init__(self) -> None:
        self.to: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        to, link, length = self.to, self.link, self.length
        last = 0
        for w in words:
            old = to[last].get(w)
            if old is not None:
                if length[old] == length[last] + 1:
                    last = old
                else:
                    last = self._clone(old, last, w)
                continue
            new = len(to)
            to.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in to[p]:
                to[p][w] = new
                p = link[p]
            if p != -1:
                q = to[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(q, p, w)
            last = new

    def _clone(self, q: int, p: int, w: int) -> int:
        to, link, length = self.to, self.link, self.length
        new = len(to)
        to.append(dict(to[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and to[p].get(w) == q:
            to[p][w] = new
            p = link[p]
        return new

    def factors(self, words: list[int]) -> list[tuple[int, int, int]]:
        """Greedy parse: (start, end, state) of the longest factor from each start on; a word that the block lacks is none."""
        to = self.to
        out, i, n = [], 0, len(words)
        while i < n:
            state, j = 0, i
            while j < n and (nxt := to[state].get(words[j])) is not None:
                state, j = nxt, j + 1
            if j > i:
                out.append((i, j, state))
            i = max(j, i + 1)
        return out

    def across(self, words: list[int], state: int, at: int, least: int) -> list[tuple[int, int]]:
        """Matches of at least `least` words that begin before the boundary `at` and end after it. state: of the factor that ends there. Its ends are tried from the longest on, each as far as it goes."""
        to, link, length = self.to, self.link, self.length
        out, j, size = [], at, length[state]
        while j < len(words):
            w = words[j]
            while state > 0 and w not in to[state]:
                if size >= least and j > at:
                    out.append((j - size, j))
                state = link[state]
                size = length[state]
                if j - size >= at:
                    return out
            if state <= 0:
                return out
            state, size, j = to[state][w], size + 1, j + 1
        if size >= least and j > at:
            out.append((j - size, j))
        return out

    def parse(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """(start, end) of all stretches of at least `least` words that the block holds: long factors, and matches across boundaries."""
        out = []
        before = (0, 0, 0)
        for i, j, state in self.factors(words):
            if j - i >= least:
                out.append((i, j))
            a, z, s = before
            if z == i and z > a and (z - a) + (j - i) >= least:
                out += self.across(words, s, i, least)
            before = (i, j, state)
        return out


def parsed(rows: list[dict], length: int, block: int = BLOCK) -> Iterator[tuple[int, bool, int, int]]:
    """(row, later, d low, d high) of windows that also start in a smaller doc. Rows are the stretches of one anchor: as their smallest doc has them, and (later) as all larger docs do."""
    words = [word_hashes(np.frombuffer(r["bytes"], np.uint8)).tolist() for r in rows]
    asked = sorted([(r["low"], False, i) for i, r in enumerate(rows)] + [(r["high"], True, i) for i, r in enumerate(rows) if r["high"] > r["low"]])
    held = [x for x in asked if not x[1]]
    for first in range(0, len(held), block):
        some = held[first : first + block]
        reference, added = ReferenceBlock(), 0
        for doc, later, i in asked:
            while added < len(some) and some[added][0] < doc:
                reference.add(words[some[added][2]])
                added += 1
            if added:
                for a, z in reference.parse(words[i], length):
                    yield i, later, rows[i]["d1"] - (z - length), rows[i]["d1"] - a


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 4, group_most: int = GROUP_MOST, block: int = BLOCK, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """docs: as keyed() gives them. Rows doc, key, a, b: word spans whose windows of `length` words also start in a smaller doc."""
    at = written(places(docs, length, gram, word_symbols), "places")
    one = contexts(at)

    def compare(rows: list[dict]) -> Iterator[tuple]:
        group: list[dict] = []
        for r in [*rows, None]:
            if group and (r is None or r["h"] != group[0]["h"]):
                for i, later, lo, hi in parsed(group, length, block):
                    yield group[i]["h"], group[i]["c"], group[i]["low"], later, lo, hi
                group = []
            group.append(r)

    ranges = decided(fetched(one, docs), compare, "h long, c long, low long, later boolean, lo int, hi int", length, word_symbols, widths, group_most)
    hit = at_places(at, one, ranges).where("later AND doc > low OR NOT later AND doc = low")
    return hit.select("doc", "key", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + length).alias("b"))


def remove_repeats(docs: DataFrame, length: int = 50, **kwargs: object) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word offsets of the maximal removed runs), kept (the words that remain, one space between)."""
    docs = keyed(docs)
    spans = spans_by_document(repeated_spans(docs, length, **kwargs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch["spans"].to_pylist(), strict=True):
                words = bytes(text.as_buffer()).split() if text.is_valid else []
                runs, kept, last = merged(spans), [], 0
                for a, b in runs:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                rows.append({"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(kept), "spans": [{"a": a, "b": b} for a, b in runs], "kept": b" ".join(kept)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("kept", pa.binary())]))

    whole = docs.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans")
    out = in_batches(whole, cut, "doc_id long, n_words long, n_removed long, spans array<struct<a:int,b:int>>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op4_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], length: int) -> list[tuple[int, int, str]]:
    """For tests: n_words, n_removed, kept_sha256 of each (doc_id, text)."""
    docs = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    low: dict[tuple, int] = {}
    for i, words in docs:
        for a in range(len(words) - length + 1):
            w = tuple(words[a : a + length])
            low[w] = min(low.get(w, i), i)
    out = []
    for i, words in docs:
        gone = [False] * len(words)
        for a in range(len(words) - length + 1):
            if low[tuple(words[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
