"""Operator 11: whiten embeddings by the exact characteristic polynomial of their scatter.

Components become whole numbers floor(1024 * c), so n times the sum of products less the product of sums, the scatter, is
a matrix of whole numbers: each task adds up its rows exactly, sums come together by place in the matrix. The scatter's characteristic
polynomial is found modulo many primes, side by side, by reduction to Hessenberg form, and put together by
Chinese remaindering. All its roots are real, so the sign changes of the polynomial moved to a point count
exactly the roots beyond it: each root is isolated by halving to BITS bits of the trace. Inverse iteration with whole numbers
at that root gives the null space and from it the component; a root of several components gives an orthonormal basis of them.
What goes through the driver is bounded by the vectors' length, not by their number.

Result for odd input: vectors that are null, empty or hold null or non-finite numbers take no part, nor do those with a number
of LARGEST and more, whose sums might not fit; only vectors of the most frequent length do (the longest of several such);
rows that repeat are rows of their own, also in the fit, and null ids are returned; components whose eigenvalue is 0 can't be scaled to unit variance and
are left out, so equal vectors and empty tables give an empty result; other columns are ignored. A deviation beyond the
range of a long is null there and whole in deviation_text.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.llm.common import in_batches, partitions, table, written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST = float(1 << 33)
#: Bits of a root, relative to the trace; further bits of numbers in elimination; bits of vectors.
BITS, GUARD, FRACTION = 240, 64, 320
#: Lengths of vectors that a task adds up at a time, rows of large numbers whose products are exact as doubles, primes in a block.
LENGTHS, EXACT, BLOCK = 4, 256, 32


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v and dim of the vectors that can take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    return v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))).withColumn("dim", F.size("v"))


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The batch's vectors as whole numbers, without SHIFT, which neither scatter nor deviation depends on."""
    return np.floor(SCALE * batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """The sum over rows of y's products, exact, as Python's whole numbers. Unless they are small, factors are cut in two parts of at most 22 bits, and rows are few, so that matrix products are exact as doubles."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    whole_of = lambda m: m.astype(np.int64).astype(object)
    largest = max(int(np.abs(y).max(initial=0)), 1)
    if largest < 1 << 22:
        step = (1 << 53) // largest**2
        return sum((whole_of(x.T @ x) for x in (y[lo : lo + step].astype(float) for lo in range(0, len(y), step))), out)
    for lo in range(0, len(y), EXACT):
        high, low = (x.astype(float) for x in np.divmod(y[lo : lo + EXACT], 1 << 22))
        cross = whole_of(high.T @ low)
        out += whole_of(low.T @ low) + ((cross + cross.T) << 22) + (whole_of(high.T @ high) << 44)
    return out


def sums(rows: DataFrame) -> DataFrame:
    """dim, i, j, value: for each length the number of vectors (-1, -1), the sums (i, -1) and the sums of products (i, j), i <= j."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for dim, (n, s, m) in held.items():
                up = np.triu_indices(dim)
                i = np.concatenate([[-1], np.arange(dim), up[0]]).astype(np.int32)
                j = np.concatenate([np.full(1 + dim, -1), up[1]]).astype(np.int32)
                value = pa.array([Decimal(int(x)) for x in [n, *s, *m[up]]], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i), pa.array(j), value], names=["dim", "i", "j", "value"])
            held.clear()

        for b in batches:
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                y = whole(b.filter(pa.array(dims == dim)), dim)
                n, s, m = held.get(dim, (0, 0, 0))
                held[dim] = [n + len(y), s + y.sum(0).astype(object), m + products(y)]
                if len(held) > LENGTHS:
                    yield from out()
        yield from out()

    parts = in_batches(rows.select("dim", "v"), add, "dim int, i int, j int, value decimal(38,0)")
    return parts.groupBy("dim", "i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


def primes(product: int) -> list[int]:
    """Primes below 2**31, largest first, until they multiply to more than product."""
    root = np.ones(46_341, bool)
    root[:2] = False
    for p in range(2, 216):
        root[p * p :: p] &= ~root[p]
    small, out, top, got = np.flatnonzero(root), [], 1 << 31, 1
    while got <= product:
        low, ok = top - (1 << 16), np.ones(1 << 16, bool)
        for p in small.tolist():
            ok[-low % p :: p] = False
        for q in (low + np.flatnonzero(ok))[::-1].tolist():
            if got > product:
                break
            out.append(q)
            got *= q
        top = low
    return out


def residues(a: np.ndarray, ps: np.ndarray) -> np.ndarray:
    """Coefficients of det(t - a) for each prime, highest power first: (primes, d + 1). a holds Python's whole numbers."""
    d, q = len(a), ps[:, None]
    h = np.stack([(a % int(p)).astype(np.int64) for p in ps])
    every = np.arange(len(ps))
    for m in range(1, d - 1):
        at = m + (h[:, m:, m - 1] != 0).argmax(1)
        h[every, at], h[:, m] = h[:, m].copy(), h[every, at].copy()
        h[every, :, at], h[:, :, m] = h[:, :, m].copy(), h[every, :, at].copy()
        inverse = np.array([pow(int(x), -1, int(p)) if x else 0 for x, p in zip(h[:, m, m - 1], ps, strict=True)])
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % q
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, None, m] % q[:, :, None]) % q[:, :, None]
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None] % q[:, :, None]).sum(2)) % q
    poly = np.zeros((len(ps), d + 1, d + 1), np.int64)  # of each leading part, lowest power first
    poly[:, 0, 0] = 1
    for k in range(d):
        weight, factor = np.ones((len(ps), k + 1), np.int64), np.ones(len(ps), np.int64)
        for i in range(k - 1, -1, -1):
            factor = factor * h[:, i + 1, i] % ps
            weight[:, i] = factor
        weight = weight * h[:, : k + 1, k] % q
        drop = (weight[:, :, None] * poly[:, : k + 1] % q[:, :, None]).sum(1) % q
        poly[:, k + 1, 1:] = poly[:, k, :-1]
        poly[:, k + 1] = (poly[:, k + 1] - drop) % q
    return poly[:, d, ::-1]


def characteristic(spark: SparkSession, a: np.ndarray) -> list[int]:
    """det(t - a), highest power first, of a symmetric matrix without negative eigenvalues. Signs alternate, and all coefficients together are at most the product of 1 + eigenvalue, so at most (1 + trace / d) ** d."""
    d = len(a)
    ps = primes((d + int(np.trace(a))) ** d // d**d + 1)
    blocks = [(ps[i : i + BLOCK],) for i in range(0, len(ps), BLOCK)] if len(ps) > BLOCK * partitions(spark) else [(ps[i :: partitions(spark)],) for i in range(min(partitions(spark), len(ps)))]

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block in f["primes"]:
                block = np.asarray(block, np.int64)
                yield pd.DataFrame({"prime": block, "c": list(residues(a, block))})

    got = spark.createDataFrame(blocks, "primes array<long>").repartition(len(blocks)).mapInPandas(reduce, "prime long, c array<long>").collect()
    return combined([r.prime for r in got], [r.c for r in got])


def combined(ps: list[int], rows: list[list[int]]) -> list[int]:
    """The coefficients with these remainders and alternating signs."""
    product = 1
    for p in ps:
        product *= p
    out = [0] * len(rows[0])
    for p, row in zip(ps, rows, strict=True):
        rest = product // p
        unit = rest * pow(rest % p, -1, p)
        for k, c in enumerate(row):
            out[k] += (c if k % 2 == 0 else -c) % p * unit
    return [(x % product) * (-1) ** k for k, x in enumerate(out)]


def beyond(c: list[int], at: int, s: int) -> int:
    """How many roots of c, all real, are above at / 2**s: the sign changes of c moved there."""
    c = [x << (s * k) for k, x in enumerate(c)]
    for end in range(len(c), 1, -1):
        for k in range(1, end):
            c[k] += at * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def isolated(c: list[int], k: int, trace: int) -> tuple[int, int, int, int] | None:
    """lo, s, above, m: the k-th largest root is above lo / 2**s and at most (lo + 1) / 2**s, as are m roots, and `above` roots are larger. None for a root of 0."""
    s = max(BITS - trace.bit_length(), 0)
    lo, hi, n_lo, n_hi = 0, trace << s, beyond(c, 0, 0), 0
    if n_lo < k:
        return None
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if n_lo - n_hi > 1:
            n = beyond(c, mid, s)
        else:  # one root: the sign at mid says on which side it is
            value = 0
            for j, x in enumerate(c):
                value = value * mid + (x << (s * j))
            n = n_lo if value and (value < 0) == (n_lo % 2 == 1) else n_hi
        if n >= k:
            lo, n_lo = mid, n
        else:
            hi, n_hi = mid, n
    return lo, s, n_hi, n_lo - n_hi


def eliminated(m: np.ndarray) -> tuple[np.ndarray, list]:
    """The upper triangle, and the steps: for each column the row exchanged and the factors, at most 1, in FRACTION bits."""
    m, steps = m.copy(), []
    for k in range(len(m)):
        at = k + int(np.argmax(np.abs(m[k:, k])))
        m[[k, at]] = m[[at, k]]
        if not m[k, k]:
            m[k, k] = 1
        f = (m[k + 1 :, k] << FRACTION) // m[k, k]
        m[k + 1 :, k:] -= (f[:, None] * m[k, k:]) >> FRACTION
        steps.append((at, f))
    return m, steps


def solved(upper: np.ndarray, steps: list, b: np.ndarray) -> np.ndarray:
    b = b.copy()
    for k, (at, f) in enumerate(steps):
        b[[k, at]] = b[[at, k]]
        b[k + 1 :] -= (f * b[k]) >> FRACTION
    for k in range(len(b) - 1, -1, -1):
        b[k] = (b[k] - (upper[k, k + 1 :] * b[k + 1 :]).sum()) // upper[k, k]
    return b


def orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    """In FRACTION bits."""
    out: list[np.ndarray] = []
    for v in vectors:
        v = (v << FRACTION) // max(int(np.abs(v).max()), 1)
        for u in out:
            v = v - ((((u * v).sum() >> FRACTION) * u) >> FRACTION)
        out.append((v << FRACTION) // max(isqrt(int((v * v).sum())), 1))
    return out


def null_space(a: np.ndarray, lo: int, s: int, m: int, rounds: int = 3) -> list[np.ndarray]:
    """The m orthonormal vectors v, in FRACTION bits, of a v = t v for the root isolated at lo. Where there are several, the iteration is at a point farther off, from which the roots look equal, so that all directions stay."""
    d = len(a)
    off = 1 << (BITS // 2) if m > 1 else 0
    upper, steps = eliminated(((a << (s + 1)) - np.eye(d, dtype=int).astype(object) * (2 * lo + 1 + off)) << GUARD)
    scale = int(np.trace(a)).bit_length() + s + GUARD
    r = np.random.default_rng(0)
    v = orthonormal([r.integers(1 << 20, 1 << 30, d).astype(object) * r.choice([-1, 1], d).astype(object) for _ in range(m)])
    for _ in range(rounds):
        v = orthonormal([solved(upper, steps, x << scale) for x in v])
    return v


def components(spark: SparkSession, n: int, scatter: np.ndarray, most: int = COMPONENTS) -> list:
    """k, e (of the covariance), explained and v of the components with eigenvalues above 0, largest first. Each is found by a task of its own."""
    trace = int(np.trace(scatter))
    if not trace:
        return []
    c = characteristic(spark, scatter)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in f["id"].tolist():
                if (at := isolated(c, k, trace)) is None:
                    continue
                lo, s, above, m = at
                v = null_space(scatter, lo, s, m)[k - above - 1]
                root = Fraction(2 * lo + 1, 2 << s)
                yield pd.DataFrame({"k": [k], "e": [float(root / (n * n))], "explained": [float(root / trace)], "v": [(v / (1 << FRACTION)).astype(float)]})

    every = spark.range(1, 1 + min(most, len(scatter)), 1, min(most, len(scatter)))
    return sorted(every.mapInPandas(find, "k int, e double, explained double, v array<double>").collect(), key=lambda r: r.k)


def projected(rows: DataFrame, n: int, s: list[int], found: list) -> DataFrame:
    """vec_id, deviation, deviation_text and w, the whitened values, of each row."""
    dim, total = len(s), np.array(s, object)
    turn = np.array([r.v for r in found]).T / np.sqrt([r.e for r in found])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = whole(b, dim)
            reach = n * int(np.abs(y).max()) + max(abs(x) for x in s)
            z = y * n - total.astype(np.int64) if reach < 1 << 62 else y.astype(object) * n - total
            square = (z * z).sum(1) if dim * reach * reach < 1 << 63 else (z.astype(object) ** 2).sum(1)
            square = [int(x) for x in square]
            w = z.astype(float) / n @ turn
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([x if x < 1 << 63 else None for x in square], pa.int64()), pa.array(list(map(str, square))), w], names=["vec_id", "deviation", "deviation_text", "w"])

    return in_batches(rows.where(F.col("dim") == dim).select("vec_id", "v"), project, "vec_id long, deviation long, deviation_text string, w array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest entry, by amount, of the covariance of w less the identity; centred before multiplying."""
    w = [F.col("w")[i] for i in range(k)]
    mean = rows.agg(*[F.avg(x) for x in w]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.avg((w[i] - mean[i]) * (w[j] - mean[j])) for i, j in pairs]).first()
    return max(abs(x - (i == j)) for x, (i, j) in zip(got, pairs, strict=True))


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text: a row for each vector that takes part and each of its `most` largest components."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = written(sums(rows), "sums")
    head = total.where("i = -1").orderBy(F.col("value").desc(), F.col("dim").desc()).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    if head is None:
        return spark.createDataFrame([], schema)
    n, dim = int(head.value), head.dim
    s, m = [0] * dim, np.zeros((dim, dim), object)
    for r in total.where((F.col("dim") == dim) & (F.col("i") >= 0)).collect():  # bounded by the vectors' length
        if r.j < 0:
            s[r.i] = int(r.value)
        else:
            m[r.i, r.j] = m[r.j, r.i] = int(r.value)
    found = components(spark, n, n * m - np.array(s, object)[:, None] * np.array(s, object), most)
    if not found:
        return spark.createDataFrame([], schema)
    out = written(projected(rows, n, s, found), "whitened")
    error = F.lit(identity_error(out, len(found))).alias("identity_error")
    explained = F.array(*[F.lit(r.explained) for r in found])
    out = out.select("vec_id", "deviation", "deviation_text", F.posexplode("w").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("i")].alias("explained"), error, "deviation_text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
