"""PCA whitening of embeddings from the exact characteristic polynomial of their integer scatter.

**Integers.** An entry c becomes ``x = floor(64 * c) + 1000000``. Rows whose vector is null, or holds null or entries that aren't finite, are
left out. With n vectors, sums S and the integer centre ``c = floor(S / n)`` of each dimension, ``z = x - c`` is small, and
``M = n * sum(z z') - T T'`` (T = S - n c) is n² times the covariance, exactly: products of 20-bit digits of z are added in
float64 matrix products that stay below 2^53, then as integers.

**Polynomial.** det(λI - M) is computed modulo 31-bit primes, a Spark task taking some of them, by reduction to Hessenberg form, and
put together by Chinese remainders. The coefficients' size is bounded by those of equal eigenvalues with the same trace.

**Roots.** All roots are real, so the sign changes of the polynomial shifted by c count the roots above c exactly, with their
multiplicities. Bisection by that count isolates the greatest roots in units of ``2^-bits``; a simple root is then bisected by the sign
of the polynomial alone. Roots that even the finest interval doesn't part are one multiple root. Zero roots are known from the
trailing coefficients and have no component.

**Components.** For each root, a Spark task factors M minus the root in fixed point with far more bits than the root has, and
iterates inversely; the vectors that come out span the null space to more than double precision. A multiple root gives as many
orthonormal vectors as it counts.

The driver holds tables of the dimension's size only (sums, scatter, polynomial, components). Repeated vectors count as
often as they come, ids may be null, no vector or no spread gives no rows, extra columns are ignored. Vectors of different lengths, and
entries whose x doesn't fit a long, are errors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.tables import arrow

SCALE, SHIFT = 64, 1_000_000
DIGIT = 20
ROWS = 8192
#: Relative precision of the roots, and what the null spaces have beyond it.
ROOT_BITS, EXTRA_BITS = 80, 160
PART = 60


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their x, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    valid = np.asarray(column.is_valid())
    flat = column.flatten()
    sizes = np.where(valid, np.asarray(column.value_lengths().fill_null(0)), 0)
    values = flat.fill_null(math.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(rows), sizes)
    bad = np.bincount(owner[~np.isfinite(values)], minlength=rows) > 0
    keep = valid & ~bad
    width = np.unique(sizes[keep])
    if len(width) > 1:
        raise ValueError(f"vectors of different lengths: {width[0]} and {width[-1]}")
    scaled = np.floor(SCALE * values[keep[owner]])
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("an entry is too large for a long")
    return keep, scaled.astype(np.int64).reshape(int(keep.sum()), int(width[0]) if len(width) else 0) + SHIFT


def _batches(batches, column: str):
    """(batch rows, kept, x) in pieces of bounded size."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            piece = batch.slice(low, ROWS)
            keep, x = integers(piece.column(column))
            if len(x):
                yield piece, keep, x


def exact_sums(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """n and the sums of x."""
    def work(batches):
        n, total = 0, None
        for _, _, x in _batches(batches, column):
            high, low = x >> 31, x & (2**31 - 1)
            sums = (high.sum(axis=0).astype(object) << 31) + low.sum(axis=0).astype(object)
            if total is not None and len(total) != len(sums):
                raise ValueError("vectors of different lengths")
            n, total = n + len(x), sums if total is None else total + sums
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))],
                names=["i", "n", "total"])
    rows = arrow(vectors.select(column), work, "i int, n long, total decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    if not rows:
        return 0, []
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    return rows[0]["n"], [int(r["total"]) for r in sorted(rows, key=lambda r: r["i"])]


def digits(z: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of DIGIT bits as float64, the lowest first."""
    out, half = [], 1 << DIGIT - 1
    while z.any():
        digit = ((z + half) & (1 << DIGIT) - 1) - half
        out.append(digit.astype(np.float64))
        z = (z - digit) >> DIGIT
    return out


def exact_scatter(vectors: DataFrame, column: str, n: int, sums: list[int]) -> np.ndarray:
    """M, an array of Python integers."""
    d = len(sums)
    centre = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(d)

    def work(batches):
        total = None
        for _, _, x in _batches(batches, column):
            parts = digits(x - centre)
            total = np.zeros((d, d), object) if total is None else total
            for a, one in enumerate(parts):
                for b, two in enumerate(parts):
                    total = total + ((one.T @ two).astype(np.int64).astype(object) << DIGIT * (a + b))
        if total is not None:
            flat = total[upper]
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)),
                 pa.array([Decimal(int(v >> PART)) for v in flat], pa.decimal128(38, 0)), pa.array([Decimal(int(v & (1 << PART) - 1)) for v in flat], pa.decimal128(38, 0))],
                names=["i", "j", "high", "low"])
    rows = arrow(vectors.select(column), work, "i int, j int, high decimal(38,0), low decimal(38,0)") \
        .groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], object)
    out = -np.outer(rest, rest)
    for r in rows:
        value = n * ((int(r["high"]) << PART) + int(r["low"]))
        out[r["i"], r["j"]] += value
        if r["i"] != r["j"]:
            out[r["j"], r["i"]] += value
    return out


def is_prime(p: int) -> bool:
    """Exact below 3,215,031,751 with these bases."""
    if p < 8 or p % 2 == 0:
        return p in (2, 3, 5, 7)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The greatest primes below 2^31 whose product exceeds the bound."""
    out, product, p = [], 1, 2**31
    while product <= bound:
        p -= 1
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(λI - matrix) modulo p, the lowest first."""
    h, d = matrix.copy(), len(matrix)
    for m in range(1, d - 1):
        pivot = np.flatnonzero(h[m:, m - 1])
        if not len(pivot):
            continue
        i = m + int(pivot[0])
        if i != m:
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    # The leading minors follow one from another.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for m in range(1, d + 1):
        minors[m, 1:] = minors[m - 1, :-1]
        product, factors = 1, np.empty(m, np.int64)
        for i in range(m - 1, -1, -1):
            factors[i] = int(h[i, m - 1]) * product % p
            product = product * int(h[i, i - 1]) % p
        minors[m] = (minors[m] - (factors[:, None] * minors[:m] % p).sum(axis=0)) % p
    return minors[d]


def characteristic_polynomial(vectors: DataFrame, matrix: np.ndarray) -> list[int]:
    """Integer coefficients of det(λI - M), the lowest first."""
    spark, d = vectors.sparkSession, len(matrix)
    trace = int(sum(matrix[i, i] for i in range(d)))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(2 * bound)
    shared = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])

    def work(batches):
        whole = np.array(shared.value, object)
        for batch in batches:
            for p in batch.column("p").to_pylist():
                found = polynomial_modulo((whole % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["p", "found"])
    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = arrow(spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks), work, "p long, found array<long>").collect()
    product = math.prod(primes)
    out = [0] * (d + 1)
    for p, found in rows:
        others = product // p
        weight = others * pow(others % p, -1, p)
        out = [(o + weight * f) % product for o, f in zip(out, found)]
    return [o - product if o > product // 2 else o for o in out]


def roots_above(polynomial: list[int], c: int) -> int:
    """How many roots of a polynomial with real roots only lie above c, each as often as it counts."""
    shifted = polynomial[::-1]
    signs = []
    for end in range(len(shifted), 0, -1):  # each synthetic division leaves one coefficient of the shifted polynomial
        for k in range(1, end):
            shifted[k] += c * shifted[k - 1]
        if shifted[end - 1]:
            signs.append(shifted[end - 1] > 0)
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(polynomial: list[int], c: int) -> int:
    value = 0
    for k in reversed(polynomial):
        value = value * c + k
    return (value > 0) - (value < 0)


def greatest_roots(polynomial: list[int], wanted: int, trace: int) -> tuple[int, list[tuple[int, int]]]:
    """Bits of the unit, and the greatest positive roots as (root in units of 2^-bits, multiplicity), falling.

    The last root may count for more than are wanted.
    """
    zero = next(k for k, c in enumerate(polynomial) if c)
    positive = polynomial[zero:]
    degree = len(positive) - 1
    wanted = min(wanted, degree)
    bits = ROOT_BITS
    while True:
        unit = [c << bits * (degree - k) for k, c in enumerate(positive)]
        found: list[tuple[int, int]] = []
        # Intervals (low, high] with the roots above low and above high; the uppermost is done first.
        open_ = [(0, (trace << bits) + 1, degree, 0)] if wanted else []
        while open_ and sum(m for _, m in found) < wanted:
            low, high, above_low, above_high = open_.pop()
            inside = above_low - above_high
            if inside == 1:
                sign = 1 if above_high % 2 == 0 else -1
                while high - low > max(1, low >> ROOT_BITS):
                    middle = (low + high) // 2
                    now = sign_at(unit, middle)
                    low, high = (low, middle) if now == sign or now == 0 else (middle, high)
                found.append((high, 1))
            elif high - low == 1:
                found.append((high, inside))
            else:
                middle = (low + high) // 2
                above = roots_above(unit, middle)
                if above_low > above:
                    open_.append((low, middle, above_low, above))
                if above > above_high:
                    open_.append((middle, high, above, above_high))
        if not found or found[-1][0].bit_length() >= ROOT_BITS:
            return bits, found
        bits += 2 * ROOT_BITS  # the smallest root has too few bits yet


def null_space(matrix: np.ndarray, bits: int, root: int, count: int, trace: int) -> np.ndarray:
    """``count`` orthonormal rows that M minus the root (in units of 2^-bits) takes to nearly nothing."""
    d = len(matrix)
    point = bits + ROOT_BITS + EXTRA_BITS
    a = matrix << bits
    for i in range(d):
        a[i, i] -= root
    a = (a << point) // (trace << bits)  # fixed point, entries up to 1
    order, lower = np.arange(d), np.zeros((d, d), object)
    for k in range(d):
        best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        for table in (a, lower):
            table[[k, best]] = table[[best, k]]
        order[[k, best]] = order[[best, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        lower[k + 1:, k] = (a[k + 1:, k] << point) // a[k, k]
        a[k + 1:, k:] -= (lower[k + 1:, k, None] * a[k, k:]) >> point
    start = np.random.default_rng(d).standard_normal((d, count))
    for _ in range(3):
        x = np.array([[int(v * 2.0**60) << point - 60 for v in row] for row in start[order]], object)
        for k in range(d):
            x[k + 1:] -= (lower[k + 1:, k, None] * x[k]) >> point
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << point) // a[k, k]
            x[:k] -= (a[:k, k, None] * x[k]) >> point
        great = max(1, max(abs(int(v)) for v in x.flat))
        start = np.linalg.qr(np.array([[int(v) / great for v in row] for row in x]))[0]
    return start.T


@dataclass
class Whitening:
    """What the fit found; ``components`` has a unit row for each of the falling ``eigenvalues``."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        centre = [s // self.n for s in self.sums]
        return (x - np.array(centre, np.int64)) - np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, centre)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """The sum over dimensions of (n x - S)², exactly."""
        widest = int(np.abs(x).max()) * self.n + max(map(abs, self.sums))
        if widest * widest * len(self.sums) >= 2**63:
            near = [s // self.n for s in self.sums]
            z = x - np.array(near, np.int64)
            rest = [s - self.n * c for s, c in zip(self.sums, near)]
            reach = (int(np.abs(z).max()) + 1) * self.n
            if reach * reach * len(rest) >= 2**63:
                return ((z.astype(object) * self.n - np.array(rest, object)) ** 2).sum(axis=1).tolist()
            return ((z * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1)
        return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1)


def fit(vectors: DataFrame, column: str, components: int = 32) -> Whitening | None:
    """The whitening of up to so many components; None if there is no vector or no spread."""
    n, sums = exact_sums(vectors, column)
    if not n or not sums:
        return None
    matrix = exact_scatter(vectors, column, n, sums)
    trace = int(sum(matrix[i, i] for i in range(len(sums))))
    if trace == 0:
        return None
    bits, roots = greatest_roots(characteristic_polynomial(vectors, matrix), components, trace)

    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])

    def work(batches):
        whole = np.array(shared.value, object)
        for batch in batches:
            for k, root, count in zip(batch.column("k").to_pylist(), batch.column("root").to_pylist(), batch.column("count").to_pylist()):
                vectors_ = null_space(whole, bits, int(root), count, trace)
                yield pa.RecordBatch.from_arrays([pa.array([k] * count, pa.int32()), pa.array(vectors_.tolist(), pa.list_(pa.float64()))], names=["k", "vector"])
    listed = spark.createDataFrame([(k, str(root), count) for k, (root, count) in enumerate(roots)], "k int, root string, count int")
    rows = arrow(listed.repartition(len(roots)), work, "k int, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: r["k"])[:components]
    unit = (n * n) << bits
    return Whitening(n, sums, np.array([r["vector"] for r in rows]), [roots[r["k"]][0] / unit for r in rows],
                     [roots[r["k"]][0] / (trace << bits) for r in rows])


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance, minus the identity."""
    k = len(model.components)

    def sums(batches):
        total = np.zeros(k)
        for _, _, x in _batches(batches, column):
            total += model.whitened(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["i", "total"])
    bare = vectors.select(column)
    mean = np.array([r[1] for r in sorted(arrow(bare, sums, "i int, total double").groupBy("i").agg(F.sum("total")).collect())]) / model.n

    def products(batches):
        total = np.zeros((k, k))
        for _, _, x in _batches(batches, column):
            w = model.whitened(x) - mean
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["i", "total"])
    entries = np.array([r[1] for r in sorted(arrow(bare, products, "i int, total double").groupBy("i").agg(F.sum("total")).collect())]) / model.n
    return float(np.abs(entries.reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, name: str = "vec_id", column: str = "embedding", components: int = 32) -> DataFrame:
    """One row per remaining vector and component: its id, component (from 1), n, deviation, whitened, explained, identity_error."""
    vectors = vectors.select(F.col(name).cast("long").alias("_name"), F.col(column).cast("array<double>").alias("_vector"))
    schema = f"`{name}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, "_vector", components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, "_vector", model), len(model.components)

    def work(batches):
        for piece, keep, x in _batches(batches, "_vector"):
            names = piece.column("_name").filter(pa.array(keep))
            rows = len(x)
            spread = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(spread)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
                 pa.array(model.deviations(x), pa.int64()).take(pa.array(spread)), pa.array(model.whitened(x).ravel()),
                 pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error))],
                names=[name, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return arrow(vectors, work, schema)
