import pytest

from pointfold.llm.mixing import mix, op8_mix_sources, rounded, take, targets


def filled(sizes: list[int], weights: list[int], total: float, cap: float) -> list[float]:
    """Targets by rounds: give by weight, cut at the caps, give the excess to the others."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


@pytest.mark.parametrize("sizes", [[5, 100, 1000, 10, 0, 3000], [10], [1, 1, 10000], [0, 0]])
def test_targets(spark, sizes):
    names = [*"abcdé"[: len(sizes) - 1], None]
    got = {r.source: (r.source_size, r.target) for r in targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")).collect()}
    want = filled(sizes, [i % 3 + 1 for i in range(len(sizes))], sum(sizes), 3)
    for n, s, w in zip(names, sizes, want, strict=True):
        assert got[n] == (s, pytest.approx(w))


def rows(n: int):
    out = [(i, "src0" if i % 3 == 0 else f"src{i % 7}", "w " * (i * 37 % 90 + 1), "x") for i in range(n)]
    return [*out, (None, None, None, None), (n, None, "a b", "x"), (n, None, "a b", "x"), (n + 1, "src1", "", "x")]


def test_mix_comes_near_targets_and_reruns_agree(spark):
    df = spark.createDataFrame(rows(2000), "doc_id long, source string, text string, id string")
    got = mix(df).collect()
    assert len(got) == 2004
    by: dict = {}
    for r in got:
        x = by.setdefault(r.source, [r.source_size, r.target, 0])
        x[2] += r.copies * r["size"]
        assert 0 <= r.copies <= 3
    for size, target, taken in by.values():
        assert abs(taken - target) <= 1
        assert target <= 3 * size
    again = mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    words = take(df).selectExpr("sum(regexp_count(text, '[^ ]+'))").first()[0]
    assert words == sum(x[2] for x in by.values())
    assert take(df).columns == df.columns


def test_rounding_is_unbiased(spark):
    n = 3000
    df = spark.createDataFrame([(i % 300, i, 10 + i % 5, 0.3) for i in range(n)], "source int, id long, size long, p double")
    ones = sum(r.extra for r in rounded(df, 4).collect())
    assert abs(ones / n - 0.3) < 0.02


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix(empty).count() == 0
    assert take(empty).count() == 0


@pytest.mark.parametrize(("sf", "most"), [("sf0.001", 0.02), ("sf0.01", 0.001), ("sf0.1", 0.0001)])
def test_every_source_comes_near_its_target(spark, sf, most):
    by: dict = {}
    for r in op8_mix_sources(spark, f"/root/testdata/{sf}").collect():
        # the query has no source; a source's size and target tell which it is
        x = by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] = x + r.taken
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
    assert len(by) == 20
    for (_, target), taken in by.items():
        assert abs(taken - target) <= most * target + 1


def test_ten_documents_come_as_near_as_any_choice_of_copies(spark):
    sizes = {"a": [900, 17, 40, 3, 250, 90, 11, 500, 61, 7], "b": [5000, 4, 4, 9, 2, 1, 30, 8, 6, 20], None: [120] * 10}
    df = spark.createDataFrame([(i, s, "w " * n) for s, all_ in sizes.items() for i, n in enumerate(all_)], "doc_id long, source string, text string")
    taken: dict = {}
    for r in mix(df).collect():
        goal, n = taken.get(r.source, (r.target, 0))
        taken[r.source] = (goal, n + r.copies * r["size"])
    for source, (goal, n) in taken.items():
        reach = {0}
        for size in sizes[source]:
            reach = {a + k * size for a in reach for k in range(4)}
        assert abs(n - goal) <= min(abs(a - goal) for a in reach) + 0.01 * goal
