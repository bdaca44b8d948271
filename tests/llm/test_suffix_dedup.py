import random

import numpy as np
import pytest

from pointfold.llm import suffix
from pointfold.llm.suffix_dedup import brute_force, op1_suffix_dedup, remove_repeats


def corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(30), text(120)
    out: list[str | None] = [None, "", "ab", "x" * 700, "ab " * 300, text(2000)]
    for _ in range(12):
        out.append(text(r.randint(0, 40)) + passage + text(r.randint(0, 40)))
    for _ in range(8):
        w = base.split(" ")
        w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [base, base, text(20) + "\n" + base[100:420]]
    for _ in range(10):
        out.append(passage[r.randint(0, 60) :] + passage[: r.randint(30, 110)])
    return out


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"shard_bytes": 1500}), (3, {"group_most": 3}), (4, {"group_most": 3, "widths": (8, 1)}), (5, {"group_most": 2, "shard_bytes": 900})])
def test_against_brute_force(spark, seed, more):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length=100, **more).collect()}
    import hashlib

    want = brute_force(texts, 100)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert (*got[i][:3], hashlib.sha256(got[i][3]).hexdigest()) == w, i


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(300)) + "y" * 20
    df = spark.createDataFrame([(1, t), (1, t), (None, "q" + t), (None, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in remove_repeats(df, length=100).collect())
    assert got == [(0, 0), (320, 320), (320, 320), (321, 320)]
    assert remove_repeats(df.limit(0), length=100).count() == 0


def test_passages_about_as_long_as_the_window(spark):
    """Only what a 400-byte string covers goes, wherever it stands; a row repeated often is compared once."""
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = []
    for size in (330, 399, 400, 500):
        p = noise(size)
        texts += [noise(r.randint(1, 700)) + p + noise(r.randint(1, 700)) for _ in range(3)] + [p, p]
    rows = list(enumerate(texts)) + [(1000, noise(900))] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in remove_repeats(df).collect())
    assert got == sorted((i, *w[:3]) for (i, _), w in zip(rows, brute_force([t for _, t in rows], 400), strict=True))
    assert sum(x[2] > 0 for x in got if x[0] < 5) == 0 and sum(x[2] > 0 for x in got if x[0] >= 10) == 10 + 300


def test_nothing_is_removed_without_the_arrays(spark, monkeypatch):
    from pointfold.llm import suffix_dedup

    docs = suffix_dedup.keyed(spark.createDataFrame(list(enumerate(corpus(1))), "doc_id long, text string"))
    assert suffix_dedup.repeated_spans(docs, 100).count() > 0

    def blind(pieces, length, shard_bytes):
        """In a task: the same stretches through the same code; but no suffix is found equal to another."""
        from pointfold.llm import suffix_dedup as m

        class Blind(m.Shard):
            def __init__(self, texts, length):
                super().__init__(texts, length)
                self.cls, self.heads = np.arange(len(self.starts)), self.starts
                self.weight = np.ones(len(self.starts), np.int64)

            def meet(self, other, length):
                pass

        seeing, m.Shard = m.Shard, Blind
        try:
            yield from m.repeated_windows(pieces, length, shard_bytes)
        finally:
            m.Shard = seeing

    monkeypatch.setattr(suffix_dedup, "repeated_windows", blind)
    assert suffix_dedup.repeated_spans(docs, 100).count() == 0


def test_copies_in_different_shards_meet_by_binary_search():
    from pointfold.llm import suffix_dedup

    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 101, 300).astype(np.uint8)) for _ in range(40)]
    rows = [{"h": 7, "d1": 250, "bytes": t, "n": 1 + i % 3} for i, t in enumerate(texts)] + [{"h": 7, "d1": 9, "bytes": texts[0][:150] + texts[3][150:], "n": 1}]
    whole = sorted(suffix_dedup.repeated_windows(suffix_dedup.by_anchor(rows), 60, 10**9))
    assert {i for i, *_ in whole} == {i for i in range(40) if i % 3} | {0, 3, 40}
    for size in (700, 1500):  # pieces of two or five, so copies and prefixes lie in different shards
        assert sorted(suffix_dedup.repeated_windows(suffix_dedup.by_anchor(rows), 60, size)) == whole


def test_query_against_brute_force(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    want = {r["doc_id"]: w for r, w in zip(rows, brute_force([r["text"] for r in rows], 400), strict=True)}
    got = {r[0]: tuple(r)[1:] for r in op1_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000


def test_suffix_array_prefixes_and_search():
    r = np.random.default_rng(0)
    for n in (9, 50, 2000):
        t = r.integers(97, 99, n).astype(np.uint8)
        t = np.concatenate([t, t[: n // 2], t[5 : n // 3]])
        b, depth = t.tobytes(), 64
        sa, tied = suffix.suffix_array(t, depth)
        s = [b[i : i + depth] for i in sa]
        assert s == sorted(s)
        assert sorted(sa) == list(range(len(t)))
        lcp = suffix.kasai(t, sa, tied, depth, lane=7)
        for k in range(1, len(sa)):
            x, y = s[k - 1], s[k]
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        other = np.concatenate([t[3:40], r.integers(97, 99, 60).astype(np.uint8)])
        starts = np.arange(len(other) - 20)
        for q, slot in zip(starts, suffix.find(t, sa, other, starts, 20), strict=True):
            w = other[q : q + 20].tobytes()
            assert (slot >= 0) == (w in b)
            assert slot < 0 or b[sa[slot] : sa[slot] + 20] == w


def test_classes_need_no_common_prefixes(monkeypatch):
    """The order itself says which windows are equal; counting their common prefixes took a third of the arrays' time."""
    from pointfold.llm import suffix, suffix_dedup

    def never(*args, **kwargs):
        raise AssertionError("common prefixes")

    monkeypatch.setattr(suffix, "kasai", never)
    r = np.random.default_rng(11)
    texts = [bytes(r.integers(97, 99, int(n)).astype(np.uint8)) for n in r.integers(12, 90, 30)]
    texts += texts[:9] + [b"a" * 70, b"ab" * 40]
    s = suffix_dedup.Shard(texts, 12)
    want = {}
    for base, t in zip(s.base.tolist(), texts, strict=True):
        for i in range(len(t) - 11):
            want.setdefault(t[i : i + 12], set()).add(base + i)
    got = {}
    for at, c in zip(s.starts.tolist(), s.cls.tolist(), strict=True):
        got.setdefault(c, set()).add(at)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
