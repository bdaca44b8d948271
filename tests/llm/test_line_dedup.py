import hashlib
import random

import pytest

from pointfold.llm import line_dedup
from pointfold.llm.line_dedup import bitmap, brute_force, drop_common_lines, kept_lines


@pytest.mark.parametrize("held", [50_000, 3])
def test_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_MOST", held)
    r = random.Random(4)
    lines = ["License ", "\tlicense", "é", "É", "", "  ", *[f"line {i % 40}" for i in range(60)]]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for i in range(150)]
    rows += [(None, None), (None, ""), (7, rows[7][1]), (7, rows[7][1]), (900, "a\nLICENSE\r\n"), (901, "x\n" * 3000 + "license")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, key string").repartition(3)
    got = sorted(((x.doc_id is None, x.doc_id), x["__lines"], x["__dropped"], hashlib.sha256((x.text or "").encode()).hexdigest(), x.key) for x in drop_common_lines(df, 5).collect())
    want = sorted(((i is None, i), *w, "k") for (i, _), w in zip(rows, brute_force(rows, 5), strict=True))
    assert got == want
    assert sum(x[2] for x in want) > 300


def test_no_rows_and_bitmaps(spark):
    assert drop_common_lines(spark.createDataFrame([], "doc_id long, text string, n_chars long")).count() == 0
    assert kept_lines("a\nb\nc", bitmap(3, [1])) == "a\nc"
    assert kept_lines(None, bitmap(1, None)) == ""
