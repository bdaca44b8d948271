import random

from pointfold.operators.components import connected
from pointfold.operators.comovement import counters, greedy_groups, objects
from pointfold.streaming import counters as by_pair


def stateful(moves: dict, resets: dict, last: int) -> dict:
    """Frame by frame: resets erase a part's counters, then both moving counts up and one of a known pair down."""
    cnt: dict = {}
    for f in range(last + 1):
        gone = resets.get(f, set())
        cnt = {p: n for p, n in cnt.items() if not gone & set(p)}
        now = moves.get(f, set())
        for p in {(a, b) for a in now for b in now if a < b} | set(cnt):
            both = sum(x in now for x in p)
            if both == 2:
                cnt[p] = cnt.get(p, 0) + 1
            elif both == 1 and p in cnt:
                cnt[p] -= 1
    return cnt


def test_closed_form_equals_frame_by_frame(spark):
    r = random.Random(1)
    moves = {f: set(r.sample(range(1, 9), r.randint(0, 5))) for f in range(40)}
    resets = {f: {r.randint(1, 8)} for f in range(40) if r.random() < 0.15}
    m = spark.createDataFrame([(f, p) for f, s in moves.items() for p in s], "frame long, label long")
    z = spark.createDataFrame([(f, p) for f, s in resets.items() for p in s], "frame long, label long")
    assert {(x.a, x.b): x.cnt for x in counters(m, z).collect()} == stateful(moves, resets, 39)


def test_even_and_odd_frames_never_merge(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(2)
    rows = [(f, p + (0 if f % 2 else 5)) for f in range(10) for p in r.sample(range(1, 6), r.randint(0, 5))]
    m = spark.createDataFrame(rows, "frame long, label long")
    for x in objects(m, m.limit(0)).collect():
        assert (x.object_id <= 5) == (x.part <= 5)


def history(seed, last):
    r = random.Random(seed)
    moves = {f: set(r.sample(range(1, 9), r.randint(0, 5))) for f in range(last)}
    resets = {f: {r.randint(1, 8)} for f in range(last) if r.random() < 0.25}
    return moves, resets


def test_stream_of_counters_equals_frame_by_frame(spark, tmp_path):
    moves, resets = history(3, 14)
    rows = {f: [(f, p, True) for p in moves[f]] + [(f, p, False) for p in resets.get(f, ())] for f in moves}
    schema = "frame long, label long, moving boolean"

    def feed(*frames):
        spark.createDataFrame([x for f in frames for x in rows[f]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        q = by_pair.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
        return {(x.a, x.b): x.cnt for x in by_pair.current(spark, str(tmp_path / "out")).collect()}

    at = 0
    for size in (1, 3, 1, 4, 1, 2):
        feed(*range(at, at + size))
        at += size
        if at > 8:
            feed(2)  # late: left out
        assert run() == stateful(moves, resets, at - 1)
    last = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    feed(12, 13)
    assert run() == stateful(moves, resets, 13)


def test_blocks_of_frames_equal_the_closed_form(spark):
    moves, resets = history(5, 30)
    m = spark.createDataFrame([(f, p) for f, s in moves.items() for p in s], "frame long, label long")
    z = spark.createDataFrame([(f, p) for f, s in resets.items() for p in s], "frame long, label long")
    want = {(x.a, x.b): x.cnt for x in counters(m, z).collect()}
    assert {(x.a, x.b): x.cnt for x in by_pair.folded(m, z, 7).collect()} == want == stateful(moves, resets, 29)
    assert by_pair.folded(m.limit(0), z.limit(0), 7).count() == 0


def plain_groups(pairs, parts):
    """Stars in order, then one pass over them."""
    near = {p: {b for a, b in pairs if a == p} | {a for a, b in pairs if b == p} for p in parts}
    free, stars = sorted(parts), []
    while free:
        p = free[0]
        stars.append((p, {p} | near[p]))
        free = [x for x in free if x not in stars[-1][1]]
    held = dict(stars)
    for c, first in stars:
        if c in held:
            for other in [o for o in held if o != c and held[o] & first]:
                held[c] = held[c] | held.pop(other)
    return {(c, p) for c, s in held.items() for p in s}


def test_greedy_groups_against_plain_python(spark):
    differ = 0
    for seed, n, m in ((0, 6, 0), (1, 25, 25), (2, 30, 24), (3, 14, 40), (4, 40, 30)):
        r = random.Random(seed)
        pairs = sorted({tuple(sorted(r.sample(range(1, n + 1), 2))) for _ in range(m)}) or [(i, i + 1) for i in range(1, n)]
        parts = list(range(1, n + 1))
        p = spark.createDataFrame(pairs, "a long, b long")
        got = {(x.object_id, x.part) for x in greedy_groups(p, spark.createDataFrame([(x,) for x in parts], "node long")).collect()}
        assert got == plain_groups(pairs, parts)
        groups = {frozenset(q for c, q in got if c == o) for o, _ in got}
        whole: dict = {}
        for x in connected(p).collect():
            whole.setdefault(x.root, {x.root}).add(x.node)
        differ += groups != {frozenset(s) for s in whole.values()} | {frozenset({q}) for q in parts if not any(q in s for s in whole.values())}
    assert differ  # one pass isn't the same as components
    none = spark.createDataFrame([], "a long, b long")
    assert greedy_groups(none, none.selectExpr("a AS node")).count() == 0
