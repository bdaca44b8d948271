"""Operator 5: documents whose sets of word n-grams are alike, by R-trees over count vectors.

Equal sets are one class from the start. Candidates come from R-trees over vectors of the sets' counts by hash group: a
tree bounds two sets' overlap by the summed minima of their counts. One tree over all sets would not partition, so sets
are dealt to trees first: two different sets as alike as asked differ in at most k n-grams, k by their sizes; if each
set's n-grams fall into more than k groups by hash, at least one group is equal in both, and sets with an equal group
meet in a tree. Pairs that pass a tree's bound connect. Each connected block is then compared in one place, by such a
tree again, and pairs that pass are verified on the sets. A group or block too large for one task goes in pairs of parts.

Components need no comparison of sets already linked through others; `class_links` compares them all.

Result for odd input: null, empty and blank texts have no n-grams and link with nothing, nor with each other; rows that
repeat are one class; component_id is the smallest doc_id that links reach, and null only where all are null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointfold.llm.common import LOWER, ODD, in_batches, mixed, partitions, table, word_hashes, written
from pointfold.llm.repeats import signed

#: Least number of hash groups of the count vectors; entries of an R-tree node; classes of a block, and of an equal group, that go to one task (larger ones go in pairs of parts).
DIMS, NODE, BLOCK_MOST, GROUP_MOST = 32, 16, 4096, 16_384
#: Bytes of texts whose signatures are compared at a time (signatures take about two thirds of that).
BUCKET_BYTES = 32 << 20


def shingles(text_bytes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of the whole sequence if it is shorter."""
    w = word_hashes(LOWER[text_bytes])
    if not len(w):
        return np.zeros(0, np.uint64)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * ODD[10 + i] + w[i : len(w) - k + 1 + i]
    return np.unique(mixed(h))


def counted(h: np.ndarray) -> np.ndarray:
    """How many of the set fall in each hash group: four to eight on average, as more would say nothing of which they are, but at least DIMS groups and at most 32 times as many. The largest number stands for all above."""
    dims = DIMS << min(max(int(len(h) / 4 / DIMS).bit_length() - 1, 0), 5)
    return np.minimum(np.bincount((h & np.uint64(dims - 1)).astype(np.int64), minlength=dims), 255).astype(np.uint8)


class Sizes:
    """Ranges of set sizes, each so narrow that alike sets are in the same or in neighbouring ranges; for each the number of groups."""

    def __init__(self, percent: int) -> None:
        self.percent, self.first = percent, [1]

    def upto(self, n: int) -> None:
        while self.first[-1] <= n:
            self.first.append(self.first[-1] * 100 // self.percent + 1)

    def of(self, n: int) -> int:
        self.upto(n)
        return int(np.searchsorted(self.first, n, side="right")) - 1

    def differ(self, r: int) -> int:
        """The most n-grams by which two alike sets differ, the larger in range r."""
        self.upto(self.first[min(r, len(self.first) - 1)])
        while len(self.first) < r + 2:
            self.upto(self.first[-1])
        return (100 - self.percent) * 2 * (self.first[r + 1] - 1) // (100 + self.percent)


#: Least number of groups beyond the most that can differ; and how likely a set of chance hashes may at most be to have empty groups that count.
SPARE, CHANCE = 3, 1e-5


@cache
def spare(k: int, percent: int) -> int:
    """Groups beyond k: as many as it takes, within a quarter of k, until a set that may differ in k of its n-grams hardly ever falls into k groups or fewer. Otherwise empty groups count for so many sets by chance that those that share one grow with the table."""
    n = k * percent // (100 - percent)
    most = SPARE + k // 4
    chance = lambda s: math.lgamma(k + s + 1) - math.lgamma(k + 1) - math.lgamma(s + 1) + n * math.log(k / (k + s))
    return next((s for s in range(SPARE, most) if chance(s) <= math.log(CHANCE)), most)


def signatures(h: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Hashes of the set's groups, for its own size range and the next. Empty groups count only if there are so many that the equal groups might all be empty; then two sets have that many empty groups in common, and so one of the first ones that are left without as many less one."""
    out = []
    r = sizes.of(len(h))
    for at in (r, r + 1):
        k = sizes.differ(at)
        if not k:
            continue
        groups = k + spare(k, sizes.percent)
        at_range = np.array([at, at], np.uint64) * np.stack([ODD[32], ODD[34]])
        g = ((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sums = np.add.reduceat(mixed(h ^ ODD[30]), first)
        sig = sums + g[first] * ODD[31] + at_range[0]
        empty = groups - len(first)
        # whatever the other's size, it is alike only if it differs in no more than this
        equal = groups - min(k, (100 - sizes.percent) * len(h) // sizes.percent)
        if empty >= equal:
            none = np.setdiff1d(np.arange(groups, dtype=np.uint64), g[first])[: empty - equal + 1]
            sig = np.concatenate([sig, none * ODD[33] + at_range[1]])
        out.append(mixed(sig))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def classes(docs: DataFrame, n: int, parts: int, percent: int) -> DataFrame:
    """Two kinds of rows: each document's set size and class (part null), and packed signatures by part: low 32 bits, and the classes that have them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, known = Sizes(percent), set()
        names = ["doc", "key", "n", "c", "counts", "part", "sig", "of"]
        sig: list[np.ndarray] = []
        of: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            s, c = np.concatenate(sig), np.concatenate(of)
            part = ((s >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            s, c, part = s[order].astype(np.uint32), c[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(first[1:], len(part))
            m = len(first)
            cols = [pa.nulls(m, pa.int64())] * 4 + [pa.nulls(m, pa.binary()), pa.array(part[first].astype(np.int32)), pa.array([s[a:b].tobytes() for a, b in zip(first, ends, strict=True)]), pa.array([c[a:b].tobytes() for a, b in zip(first, ends, strict=True)])]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            rows: list[list] = [[], [], []]
            for text in b["text"]:
                h = shingles(np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8), n)
                c = xxhash.xxh3_64_intdigest(h.tobytes(), len(h))
                rows[0].append(len(h))
                rows[1].append(signed(c))
                new = len(h) and c not in known
                rows[2].append(counted(h).tobytes() if new else None)
                if new:  # a class's signatures go out once from each task
                    known.add(c)
                    s = signatures(h, sizes)
                    sig.append(s)
                    of.append(np.full(len(s), c, np.uint64))
                    held += len(s)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b["doc"], b["key"], pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names)
            if held >= 1_000_000:
                yield packed()
                sig, of, held = [], [], 0
        if held:
            yield packed()

    return in_batches(docs.select("doc", "key", "text"), scan, "doc long, key long, n long, c long, counts binary, part int, sig binary, of binary")


def equal_groups(packed: DataFrame, parts: int) -> DataFrame:
    """g, c, m: the classes of each group that several have, and how many they are; g is a hash of these classes, so that groups of the same ones, which near copies share by the dozen, are one. One bucket of signatures is in memory at a time: twelve bytes for each class of each group in it."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []

        def done() -> Iterator[pa.RecordBatch]:
            s = np.frombuffer(b"".join(x[0] for x in blobs), np.uint32)
            c = np.frombuffer(b"".join(x[1] for x in blobs), np.uint64).view(np.int64)
            order = np.lexsort((c, s))
            s, c = s[order], c[order]
            keep = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
            s, c = s[keep], c[keep]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(first, len(s)))
            g = mixed(np.add.reduceat(mixed(c.view(np.uint64) ^ ODD[35]), first) + size.astype(np.uint64) * ODD[36])
            once = np.zeros(len(g), bool)
            once[np.unique(g, return_index=True)[1]] = True
            g, m = np.repeat(g.view(np.int64), size), np.repeat(size, size)
            at = np.flatnonzero((m > 1) & np.repeat(once, size))
            for lo in range(0, len(at), 1 << 18):
                k = at[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(g[k]), pa.array(c[k]), pa.array(m[k])], names=["g", "c", "m"])

        for b in batches:
            for p, s, c in zip(b["part"].to_pylist(), b["sig"].to_pylist(), b["of"].to_pylist(), strict=True):
                if p != part and blobs:
                    yield from done()
                    blobs = []
                part = p
                blobs.append((s, c))
        if blobs:
            yield from done()

    found = in_batches(packed.repartition(parts, "part").sortWithinPartitions("part"), match, "g long, c long, m long")
    return found.repartition(parts, "c").distinct()


def in_pairs_of_parts(df: DataFrame, members: str, most: int) -> DataFrame:
    """Adds mine and task: rows of a group of up to `most` members are in one task; of a larger group, each row is in one of its parts (mine), and a task is a pair of parts."""
    parts = F.ceil(F.col(members) / most).cast("int")
    df = df.withColumn("mine", F.pmod(F.xxhash64("c"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return df.withColumn("task", F.concat_ws("-", F.least("mine", "other"), F.greatest("mine", "other"))).drop("other")


def candidate_links(groups: DataFrame, counts: DataFrame, parts: int, percent: int, group_most: int = GROUP_MOST) -> DataFrame:
    """a, b: links that connect all classes of a group whose pairs pass the bound; as many as classes, not as pairs."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []
        current, out = None, []

        def done() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            p = widened([np.frombuffer(x[2], np.uint8) for x in held])
            if len(held) == 2:
                o = int(np.minimum(p[0], p[1]).sum())
                return [(held[0][0], held[1][0])] if (100 + percent) * o >= percent * (held[0][1] + held[1][1]) else []
            root = linked(p, np.array([x[1] for x in held]), percent)
            return [(held[r][0], held[i][0]) for i, r in enumerate(root.tolist()) if r != i]

        for b in batches:
            for g, task, c, n, v in zip(b["g"].to_pylist(), b["task"].to_pylist(), b["c"].to_pylist(), b["n"].to_pylist(), b["counts"].to_pylist(), strict=True):
                if (g, task) != current:
                    out += done()
                    held, current = [], (g, task)
                held.append((c, n, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
            out = []
        out = done()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    rows = in_pairs_of_parts(groups.join(counts, "c"), "m", group_most).select("g", "task", "c", "n", "counts")
    return in_batches(rows.repartition(parts, "g", "task").sortWithinPartitions("g", "task"), bound, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """c, root: the least node that links (a, b) connect c with. Each round ties a node's neighbours to the least of them, from above and from below in turn, until nothing changes; rounds grow as the logarithm of the longest path."""
    e = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e1 = written(large.where("u <> v").distinct(), "large")
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        small = e1.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("c"), F.col("v").alias("root"))
        before = now


class RTree:
    """Points (count vectors) in nodes of NODE, bulk-loaded in order of size and of the widest coordinates; a node has its points' largest counts and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        wide = np.argsort(-points.var(0))[:3]
        self.order = np.lexsort((*[points[:, d] // 2 for d in wide[::-1]], np.log2(sizes).round(1)))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > NODE:
            p, s = self.levels[-1]
            cut = np.arange(0, len(s), NODE)
            self.levels.append((np.maximum.reduceat(p, cut), np.minimum.reduceat(s, cut)))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose overlap with this one, by the bound, may be enough. An overlap o is enough if 100 o >= percent (a + b - o)."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, s = self.levels[depth]
            at = at[at < len(s)]
            bound = np.minimum(p[at], point).sum(1)
            at = at[(100 + percent) * bound >= percent * (s[at] + size)]
            if depth:
                at = (at[:, None] * NODE + np.arange(NODE)).ravel()
        return self.order[at]


def widened(counts: list[np.ndarray]) -> np.ndarray:
    """Counts to compare, with as many groups as the shortest has; one at its limit may stand for any number."""
    dims = min(len(c) for c in counts)
    out = np.zeros((len(counts), dims), np.int64)
    for i, c in enumerate(counts):
        w = c.astype(np.int64)
        w[c == 255] = 1 << 40
        out[i] = w.reshape(-1, dims).sum(0)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def linked(points: np.ndarray, sizes: np.ndarray, percent: int, sets: list[np.ndarray] | None = None, only_across: np.ndarray | None = None) -> np.ndarray:
    """For each point the least index that links connect it with: pairs that pass the bound and, given sets, are alike. only_across: pairs with different marks only. Ends as soon as all are connected."""
    n = len(points)
    root = np.arange(n)
    left = n
    tree = RTree(points, sizes)
    for i in range(n):
        if left == 1:
            break
        near = tree.near(points[i], int(sizes[i]), percent)
        near = near[root[near] != root[i]]
        if only_across is not None:
            near = near[only_across[near] != only_across[i]]
        if sets is None and len(near):
            joined = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, joined)] = joined[0]
            left -= len(joined) - 1
            continue
        for j in near.tolist():
            if root[i] == root[j]:
                continue
            same = overlap(sets[i], sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                low, high = min(root[i], root[j]), max(root[i], root[j])
                root[root == high] = low
                left -= 1
    return root


def all_links(points: np.ndarray, sizes: np.ndarray, percent: int, sets: list[np.ndarray], only_across: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """Every pair of points that are alike, with their common members."""
    tree = RTree(points, sizes)
    for i in range(len(points)):
        near = tree.near(points[i], int(sizes[i]), percent)
        near = near[near > i]
        if only_across is not None:
            near = near[only_across[near] != only_across[i]]
        for j in near.tolist():
            same = overlap(sets[i], sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                yield i, j, same


def blocks(docs: DataFrame, n: int, percent: int, group_most: int = GROUP_MOST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every document's doc, key, set size and class; each class's c, low, rep and rows; root and members of the blocks (classes that candidate pairs connect) of several classes; and their c, root, members and text."""
    parts = partitions(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    both = written(classes(plain, n, max(parts, size // BUCKET_BYTES), percent), "classes")
    every = both.where("part IS NULL").select("doc", "key", "n", "c")
    groups = equal_groups(both.where("part IS NOT NULL").select("part", "sig", "of"), parts)
    counts = both.where("counts IS NOT NULL").groupBy("c").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    block = components(candidate_links(groups, counts, parts, percent, group_most))
    block = written(block.union(block.select(F.col("root").alias("c"), "root")).distinct(), "blocks")
    members = block.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
    low = every.where("n > 0").groupBy("c").agg(F.min("doc").alias("low"), F.min(F.struct("doc", "key")).alias("rep"), F.count("*").alias("rows"))
    wanted = low.join(block.join(members, "root"), "c").select("c", "root", "members", "rep.doc", "rep.key")
    return every, low, members, wanted.join(plain, ["doc", "key"]).select("c", "root", "members", "text")


def compared(texts: DataFrame, n: int, percent: int, block_most: int, every_pair: bool) -> DataFrame:
    """a, b, same: links between the classes of each block, with the n-grams that they share; of all pairs, or (same is null) as few as connect what is linked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            ids = sorted(held)
            mine = np.array([held[c][1] for c in ids])
            marks = mine if len(set(current[1].split("-"))) > 1 else None
            sets = [held[c][0] for c in ids]
            points, sizes = widened([counted(x) for x in sets]), np.array([len(x) for x in sets])
            if every_pair:
                links = ((ids[i], ids[j], same) for i, j, same in all_links(points, sizes, percent, sets, marks))
            else:
                links = ((ids[r], ids[i], None) for i, r in enumerate(linked(points, sizes, percent, sets, marks).tolist()) if r != i)
            while some := list(islice(links, 1 << 16)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], pa.int64()) for k in range(3)], names=["a", "b", "same"])

        for b in batches:
            for root, task, mine, c, text in zip(b["root"].to_pylist(), b["task"].to_pylist(), b["mine"].to_pylist(), b["c"].to_pylist(), b["text"], strict=True):
                if current != (root, task):
                    if len(held) > 1:
                        yield from done()
                    held, current = {}, (root, task)
                if c not in held:  # equal rows may repeat
                    held[c] = (shingles(np.frombuffer(text.as_buffer(), np.uint8), n), mine)
        if len(held) > 1:
            yield from done()

    placed = in_pairs_of_parts(texts, "members", block_most)
    sorted_ = placed.repartition(partitions(texts.sparkSession), "root", "task").sortWithinPartitions("root", "task").select("root", "task", "mine", "c", "text")
    return in_batches(sorted_, compare, "a long, b long, same long")


def alike(docs: DataFrame, n: int = 4, percent: int = 85, block_most: int = BLOCK_MOST, group_most: int = GROUP_MOST) -> DataFrame:
    """docs: doc_id and text. doc (see keyed), key, n, component: the smallest doc that links of at least `percent` connect with, for every document."""
    every, low, members, texts = blocks(docs, n, percent, group_most)
    found = written(compared(texts, n, percent, block_most, False).select("a", "b"), "found")
    # within one task the links are stars already; across tasks of one block they may not be
    root = components(found) if members.where(F.col("members") > block_most).limit(1).count() else found.select(F.col("b").alias("c"), F.col("a").alias("root"))
    # only classes with several rows or links have a component other than themselves
    named = low.join(root, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.join(root.select("root").distinct().withColumn("linked", F.lit(True)), "root", "left").where("linked OR rows > 1")
    tops = least.groupBy("root").agg(F.min("low").alias("component"))
    of_class = least.select("c", "root").join(tops, "root").select("c", "component")
    return every.join(of_class, "c", "left").select("doc", "key", "n", F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component"))


def class_links(docs: DataFrame, n: int = 4, percent: int = 85, block_most: int = BLOCK_MOST, group_most: int = GROUP_MOST) -> tuple[DataFrame, DataFrame]:
    """Every link, as pairs of classes of documents with equal sets, not of documents; and the membership.

    Pairs: a, b (class ids), same (common n-grams), both ways round. Membership: doc, key, n, c (its class; null without n-grams) and
    links: with how many other documents it links, those of its own class included. Pairs grow with the square of a group of
    alike but different sets: use alike() where components are enough.
    """
    every, low, _, texts = blocks(docs, n, percent, group_most)
    one_way = written(compared(texts, n, percent, block_most, True), "links")
    pairs = one_way.union(one_way.select("b", "a", "same"))
    others = pairs.join(low.select(F.col("c").alias("b"), "rows"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("rows").alias("others"))
    count = low.select("c", "rows").join(others, "c", "left").select("c", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    members = every.join(count, "c", "left").select("doc", "key", "n", F.when(F.col("n") > 0, F.col("c")).alias("c"), F.coalesce("links", F.lit(0)).alias("links"))
    return pairs, members


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = 2**63 - 1
    out = alike(table(spark, sf_dir, "documents"))
    return out.select(F.when(F.col("doc") != null, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component") != null, F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component (of rows with the same doc_id and text, one); documents without n-grams all stay."""
    stay = alike(docs, n, percent).where("doc = component").select("doc", "key")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"))
    kept = rows.join(stay, ["doc", "key"], "left_semi")
    # of rows equal in doc_id and text, but perhaps not in other columns, the same one stays whatever the order of reading
    first = F.row_number().over(Window.partitionBy("doc", "key").orderBy(F.xxhash64(F.to_json("row"))))
    return kept.withColumn("nr", first).where("nr = 1").select("row.*")


def brute_force(rows: list[tuple[int | None, str | None]], n: int, percent: int) -> list[tuple[int | None, int, int | None]]:
    """For tests: doc_id, n_shingles, component_id."""
    fold = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = (t or "").translate(fold).encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    label = [2**63 - 1 if i is None else i for i, _ in rows]
    ids = list(label)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    null = 2**63 - 1
    return [(None if i == null else i, len(s), None if x == null else x) for i, s, x in zip(ids, sets, label, strict=True)]
