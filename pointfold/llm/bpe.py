"""Operator 7: BPE encoding and decoding with the vocabulary of a public tokenizer file.

Merges of a word come from a priority queue of (rank, place) over a doubly linked list of its symbols; an entry
whose symbols have changed meanwhile is stale and skipped. Decoding joins the vocabulary's strings as the file's
(absent) decoder does, one space between.

Result for odd input: null text is empty and has no tokens; repeated rows give repeated results; other columns
pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.llm.common import in_batches, table

#: Words kept in a task's memory, so that a word is merged once; beyond, the memory starts anew.
MEMORY = 200_000
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is one, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def newer_letters() -> frozenset[str]:
    """Letters and digits that the regex library knows but Python's own tables, and the tokenizer's, don't have yet."""
    free = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}]", free))


class Vocabulary:
    """A tokenizer file with lower-casing, white space dropped and an end-of-word mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model = d["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: A pair of ids, as one number, to the rank of its merge; and what each rank makes.
        self.wide = max(self.ids.values()) + 1
        self.ranks = {self.ids[a] * self.wide + self.ids[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace("[^\\s", f"[^{WHITE}")
        self.words = regex.compile(pattern)
        self.newer = newer_letters()
        new = "".join(f"\\U{ord(c):08x}" for c in self.newer)
        # sets this large are slow, so only texts that hold such letters go by them
        self.words_without_newer = regex.compile(pattern.replace(f"[^{WHITE}\\p{{L}}\\p{{N}}]", f"[[^{WHITE}\\p{{L}}\\p{{N}}]||[{new}]]").replace("[\\p{L}]", f"[\\p{{L}}--[{new}]]").replace("|[\\p{N}]|", f"|[\\p{{N}}--[{new}]]|"), regex.V1) if new else self.words
        #: The ids of a byte inside a word and at its end; None where the vocabulary lacks it.
        self.inner, self.final = ([self.ids.get(c + e) for c in byte_letters()] for e in ("", self.end))
        self.digits = {i: str(i) for i in self.names}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory: dict[str, tuple[str, str, int]] = {}

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        out = [self.inner[b] for b in data[:-1]]
        out.append(self.final[data[-1]])
        return [x for x in out if x is not None]

    def merged(self, sym: list[int]) -> list[int]:
        """Ids left when no pair merges. The queue holds rank * n + place; an entry whose place no longer starts a pair of that rank is stale."""
        n, ranks, made, wide = len(sym), self.ranks, self.made, self.wide
        heap = [r * n + i for i in range(n - 1) if (r := ranks.get(sym[i] * wide + sym[i + 1])) is not None]
        if not heap:
            return sym
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i = divmod(pop(heap), n)
            j = right[i]
            if j < 0 or sym[i] < 0 or ranks.get(sym[i] * wide + sym[j]) != rank:
                continue  # stale
            s = sym[i] = made[rank]
            sym[j] = -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get(s * wide + sym[k])) is not None:
                    push(heap, r * n + i)
            h = left[i]
            if h >= 0 and (r := ranks.get(sym[h] * wide + s)) is not None:
                push(heap, r * n + h)
        return [s for s in sym if s >= 0]

    def word(self, word: str) -> tuple[str, str, int]:
        """Ids and decoded strings, each joined by a space, and their number."""
        ids = self.merged(self.symbols(word))
        found = (" ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids]), len(ids))
        if len(word) < 64:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = found
        return found

    def encode(self, text: str) -> tuple[str, str, int]:
        """Of a text: ids joined by a space, the decoded text, and the number of tokens."""
        ids: list[str] = []
        back: list[str] = []
        total = 0
        get, word = self.memory.get, self.word
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                ids.append(str(self.special[piece]))
                back.append(piece)
                total += 1
                continue
            # white space needs no cleaning: no pattern of a word matches it
            piece = unicodedata.normalize("NFC", piece)
            # letter by letter where a capital's neighbours would matter
            piece = "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()
            pattern = self.words if piece.isascii() or self.newer.isdisjoint(piece) else self.words_without_newer
            for w in pattern.findall(piece):
                i, b, n = get(w) or word(w)
                if n:
                    ids.append(i)
                    back.append(b)
                    total += n
        return " ".join(ids), " ".join(back), total

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The columns of docs with __ids (decimal, one space between), __decoded and __tokens. path: of the tokenizer's file, the same on every executor."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        v.memory = {}
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = [v.encode(t or "") for t in part["row"].field("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part["row"], *[pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]], names=["row", "__ids", "__decoded", "__tokens"])
        v.memory = {}

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return in_batches(rows, scan, f"row {rows.schema['row'].dataType.simpleString()}, __ids string, __decoded string, __tokens long").select("row.*", "__ids", "__decoded", "__tokens")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe_path())
    return digest(out)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.col("__tokens").alias("n_tokens"), F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))


def library(texts: list[str | None], path: str) -> list[tuple[int, str, str]]:
    """For tests: n_tokens, ids_sha256, decoded_sha256 by the tokenizers library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out
