"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Each entry c becomes the integer floor(64 c) + 1000000.  Over the list of
distinct vectors (n of them, sums S) the scatter n * sum(x x') - S S' is a
matrix of whole numbers, n * n times the covariance.  Its characteristic
polynomial is found exactly: modulo primes below 2**31 the matrix is reduced to
Hessenberg form, one Spark row for each prime, and the residues are put together
by the Chinese remainder theorem.  All roots are real, so Descartes' rule counts
those above any point exactly; bisection isolates the largest ones, repeated
ones included, and narrows them to hundreds of bits.  Inverse iteration in 150
decimal digits, one Spark row for each isolated root, gives the components.

What is held whole is a square of the dimension, never of the rows: partial
moments are added up by Spark, exactly, in two halves of 64 bits and more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, written

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Integers beyond this are held at it: a long has no room for more.
FARTHEST = 1 << 60
#: Bits that tell neighbouring roots apart, bits that an isolated root is narrowed to, and decimal digits of the inverse iteration.
APART, NARROW, DIGITS = 160, 240, 150
HALF = 64


def whole_vectors(embeddings: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, y): the integers less 1000000 of each row whose vector has finite entries only, all of one length.

    Rows with a null vector or a null, infinite or NaN entry are dropped.  Vectors of
    another length than most rows have (of two such lengths the larger) cannot be
    set against the rest and are dropped too.
    """
    vector = F.col(column)

    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), vector.cast("array<double>").alias("c"))
    rows = rows.where(F.col("c").isNotNull() & F.forall("c", fine) & (F.size("c") > 0))
    sizes = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    bound = float(FARTHEST)
    y = F.transform("c", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))))
    return rows.where(F.size("c") == F.lit(sizes["d"] if sizes else 0)).select("vec_id", y.cast("array<long>").alias("y"))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of lists of equal length as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cells(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the sums of products of fit(y), exact.

    Tasks send one row for each cell; Spark adds them up; the driver holds d * d numbers.
    """

    @tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in slices(batches, 4096):
            y = matrix(batch.column(0))
            n += len(y)
            if y.size and max(int(y.max()), -int(y.min())) < 1 << 20:  # whole numbers below 2**53: doubles are exact
                f = y.astype(np.float64)
                sums += f.sum(axis=0).astype(np.int64).astype(object)
                products += (f.T @ f).astype(np.int64).astype(object)
            else:
                o = y.astype(object)
                sums += o.sum(axis=0)
                products += o.T @ o
        values = [n, *sums, *(products[i, j] for i, j in cells(d))]
        kind = pa.decimal128(38, 0)
        high, low = pa.array([Decimal(int(v) >> HALF) for v in values], kind), pa.array([Decimal(int(v) & (1 << HALF) - 1) for v in values], kind)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), high, low], names=["cell", "high", "low"])

    parts = fit.select("y").mapInArrow(partial, "cell int, high decimal(38,0), low decimal(38,0)")
    total = {r["cell"]: (int(r["high"]) << HALF) + int(r["low"]) for r in parts.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    values = [total.get(k, 0) for k in range(1 + d + d * (d + 1) // 2)]
    products = np.zeros((d, d), dtype=object)
    for (i, j), v in zip(cells(d), values[1 + d :], strict=True):
        products[i, j] = products[j, i] = v
    return values[0], values[1 : 1 + d], products


def primes_below(top: int, count: int) -> list[int]:
    """The largest ``count`` primes below ``top`` (at most 2**31), by Fermat-Miller witnesses that decide there."""

    def prime(p: int) -> bool:
        if p % 2 == 0 or any(p % q == 0 and p != q for q in (3, 5, 7, 11, 13, 17, 19)):
            return False
        twos = ((p - 1) & -(p - 1)).bit_length() - 1
        for base in (2, 3, 5, 7):
            x = pow(base, (p - 1) >> twos, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                return False
        return True

    found, p = [], top - 1
    while len(found) < count:
        if prime(p):
            found.append(p)
        p -= 1
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of det(x - matrix) modulo a prime below 2**31.

    Similar row and column steps make the matrix upper Hessenberg; the
    polynomials of its leading blocks follow one from another.
    """
    h = np.array([[int(v) % p for v in row] for row in matrix], dtype=np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        ratio = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - ratio[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * ratio % p).sum(axis=1)) % p
    blocks = np.zeros((d + 1, d + 1), dtype=np.int64)
    blocks[0, 0] = 1
    for k in range(d):
        weights, product = np.zeros(k + 1, dtype=np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        new = -(weights[:, None] * blocks[: k + 1] % p).sum(axis=0) % p
        new[1:] = (new[1:] + blocks[k, :-1]) % p
        blocks[k + 1] = new
    return [int(c) for c in blocks[d]]


def characteristic_polynomial(spark, scatter: np.ndarray) -> list[int]:
    """Coefficients, lowest first, of det(x - scatter) for a positive semidefinite matrix of whole numbers, exact.

    By Maclaurin's inequality no coefficient exceeds C(d, k) * (trace / d)**k; enough primes are taken for that.
    """
    d, trace = len(scatter), int(sum(scatter[i, i] for i in range(len(scatter))))
    bits = max((math.comb(d, k) * trace**k // d**k).bit_length() for k in range(d + 1)) + 2
    primes = primes_below(1 << 31, bits // 30 + 1)
    rows = [[int(v) for v in row] for row in scatter]

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([polynomial_modulo(rows, p) for p in own], pa.list_(pa.int64()))], names=["p", "c"])

    spread = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    whole, modulus = [0] * (d + 1), 1
    for row in spread.mapInArrow(residues, "p long, c array<long>").collect():
        p = row["p"]
        inverse = pow(modulus, -1, p)
        whole = [w + modulus * ((c - w) * inverse % p) for w, c in zip(whole, row["c"], strict=True)]
        modulus *= p
    return [w - modulus if 2 * w > modulus else w for w in whole]


class Roots:
    """The positive roots of a polynomial all of whose roots are real and not negative.

    Points are whole numbers of 2**-``bits``.
    """

    def __init__(self, coefficients: list[int], bits: int):
        zeros = next(i for i, c in enumerate(coefficients) if c)
        own = coefficients[zeros:]
        self.rank, self.bits = len(own) - 1, bits
        self.own = [c << bits * (self.rank - i) for i, c in enumerate(own)]

    def above(self, point: int) -> int:
        """How many roots, with their multiplicity, are larger: sign changes after the shift, exact as all roots are real."""
        c = list(self.own)
        for i in range(self.rank):
            for j in range(self.rank - 1, i - 1, -1):
                c[j] += point * c[j + 1]
        signs = [v > 0 for v in c if v]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, point: int) -> int:
        value = 0
        for c in reversed(self.own):
            value = value * point + c
        return (value > 0) - (value < 0)

    def isolated(self, top: int, wanted: int) -> list[tuple[int, int, int]]:
        """(low, high, multiplicity), largest first, of the first ``wanted`` roots: low < root <= high.

        Several roots in one interval agree in their first ``APART`` bits.
        """
        found, stack = [], [(0, top, self.rank, 0)]
        while stack:
            low, high, more, less = stack.pop()  # roots above low, above high
            if more == less or less >= wanted:
                continue
            if more - less == 1 and low or (high - low) << APART <= low:
                found.append((low, high, more - less))
                continue
            mid = (low + high) // 2
            at = self.above(mid)
            stack += [(low, mid, more, at), (mid, high, at, less)]
        return found

    def narrowed(self, low: int, high: int) -> int:
        """The only root in (low, high] to ``NARROW`` bits."""
        if self.sign(high) == 0:
            return high
        end = self.sign(high)
        while (high - low) << NARROW > high and high - low > 1:
            mid = (low + high) // 2
            at = self.sign(mid)
            if at == 0:
                return mid
            low, high = (low, mid) if at == end else (mid, high)
        return (low + high) // 2


def null_space(scatter: list[list[int]], point: int, bits: int, count: int) -> np.ndarray:
    """``count`` orthogonal unit vectors that scatter - point * 2**-bits sends to next to nothing, by inverse iteration."""
    d = len(scatter)
    with localcontext(Context(prec=DIGITS)):
        a = np.array([[Decimal(v) for v in row] for row in scatter], dtype=object)
        root = Decimal(point) / Decimal(1 << bits)
        tiny = max(root, Decimal(1)) * Decimal(10) ** (8 - DIGITS)
        for i in range(d):
            a[i, i] -= root
        order = list(range(d))
        for k in range(d):
            at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if at != k:
                a[[k, at]] = a[[at, k]]
                order[k], order[at] = order[at], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])
        draw = np.random.default_rng(7).integers(-999, 1000, (count, d))
        vectors = [np.array([Decimal(int(x)) for x in row], dtype=object) for row in draw]
        for _ in range(4):
            done: list[np.ndarray] = []
            for v in vectors:
                v = v[order]
                for k in range(1, d):
                    v[k] -= a[k, :k] @ v[:k]
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (a[k, k + 1 :] @ v[k + 1 :] if k + 1 < d else 0)) / a[k, k]
                v = v / (v @ v).sqrt()
                for _ in range(2):
                    for other in done:
                        v = v - (v @ other) * other
                    v = v / (v @ v).sqrt()
                done.append(v)
            vectors = done
        return np.array([[float(x) for x in v] for v in vectors])


def components(spark, scatter: np.ndarray, wanted: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """(share of the trace, unit vector) of the largest eigenvalues above zero, largest first.

    Fewer than ``wanted`` where the rank is lower; equal eigenvalues give an orthogonal set.
    """
    trace = int(sum(scatter[i, i] for i in range(len(scatter))))
    if not trace:
        return []
    coefficients, bits = characteristic_polynomial(spark, scatter), 2 * NARROW
    while True:
        roots = Roots(coefficients, bits)
        intervals = roots.isolated((trace + 1) << bits, wanted)
        if all(low.bit_length() > NARROW for low, _, _ in intervals):
            break
        bits *= 2
    rows = [[int(v) for v in row] for row in scatter]
    whole = (trace, bits)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, low, high, many in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                low, high = int(low), int(high)
                at = roots.narrowed(low, high) if many == 1 else (low + high) // 2
                share = at / (whole[0] << whole[1])
                got = null_space(rows, at, whole[1], many)
                yield pa.RecordBatch.from_arrays([pa.array([place] * many, pa.int32()), pa.array([share] * many, pa.float64()), pa.array(got.tolist(), pa.list_(pa.float64()))], names=["place", "share", "vector"])

    jobs = spark.createDataFrame([(k, str(low), str(high), many) for k, (low, high, many) in enumerate(intervals)], "place int, low string, high string, many int")
    got = jobs.repartition(len(intervals)).mapInArrow(vectors, "place int, share double, vector array<double>").collect()
    return [(r["share"], np.array(r["vector"])) for r in sorted(got, key=lambda r: r["place"])][:wanted]


def whiten(embeddings: DataFrame, column: str = "embedding", key: str = "vec_id", wanted: int = COMPONENTS) -> DataFrame:
    """One row for each kept vector and component: see SCHEMA.

    Components with eigenvalue zero have no whitened values and are left out: fewer
    rows than ``wanted`` a vector where the rank is lower, none where the fit list has
    one vector or none.  Null and repeated ids stay, each row with its own values;
    repeated vectors count once in the fit.  ``deviation`` is null where it does not
    fit a long.  Other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings, column, key)
    fit = written(rows.select("y").distinct(), "fit")
    first = fit.first()
    d = len(first["y"]) if first else 0
    n, sums, products = moments(fit, d) if d else (0, [], np.zeros((0, 0), dtype=object))
    scatter = n * products - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object)) if d else products
    found = components(spark, scatter, wanted) if d else []
    if not found:
        return spark.createDataFrame([], SCHEMA)
    trace = int(sum(scatter[i, i] for i in range(d)))
    roots = [share * (trace / n**2) for share, _ in found]
    turn = np.array([v / math.sqrt(e) for (_, v), e in zip(found, roots, strict=True)]).T
    m = len(found)

    def centred(y: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n * x - S, and the sums of its squares."""
        far = max(int(y.max()), -int(y.min())) if y.size else 0
        most = n * far + max(map(abs, sums))
        if most * most * d < 1 << 63:
            off = n * y - np.array(sums, dtype=np.int64)
            return off.astype(np.float64), (off * off).sum(axis=1).tolist()
        off = n * y.astype(object) - np.array(sums, dtype=object)
        squares = (off * off).sum(axis=1)
        return off.astype(np.float64), [int(s) if s < 1 << 63 else None for s in squares]

    @tidy
    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((m, m)), np.zeros(m)
        for batch in slices(batches, 4096):
            w = centred(matrix(batch.column(0)))[0] / n @ turn
            total += w.T @ w
            mean += w.sum(axis=0)
        values = [*total.ravel(), *mean]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], names=["cell", "v"])

    got = {r["cell"]: r["v"] / n for r in fit.select("y").mapInArrow(squares, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([got[m * m + k] for k in range(m)])
    covariance = np.array([got[k] for k in range(m * m)]).reshape(m, m) - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(m)).max())
    shares = [share for share, _ in found]

    @tidy
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            off, deviation = centred(matrix(batch.column(1)))
            w, k = off / n @ turn, batch.num_rows
            each = pa.array(np.repeat(np.arange(k), m))
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n)), pa.array(deviation, pa.int64()).take(each)]
            columns += [pa.array(w.ravel()), pa.array(np.tile(shares, k)), pa.array(np.full(k * m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, SCHEMA)
