import hashlib
import random

import pyarrow.parquet as pq
import pytest

from pointfold.llm import lz_dedup
from pointfold.llm.lz_dedup import ReferenceBlock, brute_force, op4_lz_dedup, remove_repeats


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    text = lambda n: [r.choice("ab cd ef gh ijk lmn é".split()) for _ in range(n)]
    passage, base = text(25), text(80)
    out: list[str | None] = [None, "", " \t\n", "x " * 300, " ".join(text(900))]
    for _ in range(14):
        out.append("\n".join([" ".join(text(r.randint(0, 9)) + passage + text(r.randint(0, 9))), "\x1c \x85 end"]))
    for _ in range(8):
        w = list(base)
        w[r.randrange(len(w))] = "edit"
        out.append("  ".join(w))
    out += [" ".join(base)] * 2 + [" ".join(passage[r.randint(0, 5) :] + passage[: r.randint(10, 25)]) for _ in range(8)]
    ids: list[int | None] = list(range(len(out)))
    r.shuffle(ids)
    ids[3], ids[9] = None, ids[10]
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"block": 2}), (3, {"group_most": 3}), (4, {"group_most": 2, "block": 3, "widths": (4, 1)})])
def test_against_brute_force(spark, seed, more):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, doc int").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in remove_repeats(df, length=20, gram=4, **more).collect())
    want = sorted(((i is None, i), *w) for (i, _), w in zip(rows, brute_force(rows, 20), strict=True))
    assert got == want
    assert sum(x[2] for x in want) > 50


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    want = {i: w for (i, _), w in zip(rows, brute_force(rows, 50), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in op4_lz_dedup(spark, "/root/testdata/sf0.001").collect()} == want
    assert sum(w[1] for w in want.values()) > 100


def test_nothing_is_removed_without_the_parse(spark, monkeypatch):
    docs = lz_dedup.keyed(spark.createDataFrame(corpus(1), "doc_id long, text string"))
    assert lz_dedup.repeated_spans(docs, 20).count() > 0

    def blind(rows, length, block):
        """In a task: the same stretches and blocks; but the parse gives no factors."""
        from pointfold.llm import lz_dedup as m

        seeing, m.ReferenceBlock.factors = m.ReferenceBlock.factors, lambda self, words: []
        try:
            yield from m.parsed(rows, length, block)
        finally:
            m.ReferenceBlock.factors = seeing

    monkeypatch.setattr(lz_dedup, "parsed", blind)
    assert lz_dedup.repeated_spans(docs, 20).count() == 0


def test_a_row_repeated_often(spark):
    t = " ".join(f"w{i * i % 89}" for i in range(70))
    rows = [(5, t)] * 500 + [(7, "q " + t), (None, "r " + t), (5, None)]
    got = sorted((r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 0)] + [(70, 0)] * 500 + [(71, 70)] * 2


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parse_finds_all_long_factors():
    r = random.Random(5)
    for _ in range(60):
        texts = [[r.randrange(3) for _ in range(r.randint(0, 25))] for _ in range(4)]
        block = ReferenceBlock()
        for t in texts:
            block.add(t)
        t = [r.randrange(3) for _ in range(40)]
        least = 6
        held = {tuple(x[i : i + least]) for x in texts for i in range(len(x) - least + 1)}
        want = {i for i in range(len(t) - least + 1) if tuple(t[i : i + least]) in held}
        assert {i for a, b in block.parse(t, least) for i in range(a, b - least + 1)} == want
