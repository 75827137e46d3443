"""Whitening of embeddings from exact integer statistics.

Components are scaled and floored to integers, so counts, sums and the scatter are exact.  Copies of a vector count once: the
statistics of all rows are taken without a shuffle, and what copies add too much is subtracted again, which integers
allow; only 64-bit hashes and the vectors that have copies are shuffled.

The characteristic polynomial of the integer matrix ``n * Q - S S'`` (n**2 times the covariance) is computed modulo primes by
Hessenberg reduction, a few primes a task, and put together by Chinese remaindering.  All its roots are real, so the sign changes
of its shifted coefficients count the roots above any point exactly; bisection isolates the largest ones to 200 bits below the
trace.  Inverse iteration with integers of that precision gives the null space at each root.
"""
from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import arrow_map, materialize, maybe_member

SCALE, COMPONENTS = 256, 4
#: width of the roots' intervals, in bits below the trace
PRECISION = 200
#: rows whose products are added at once
ROWS = 4096
DIGITS = 60
LONG_MAX = (1 << 63) - 1


# --- statistics ----------------------------------------------------------------------------

def usable(v: Column) -> Column:
    """Not null, not empty, without null or non-finite entries."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def as_integers(column: pa.Array, scale: int | None) -> np.ndarray:
    """All entries of the lists as ``floor(scale * c)``; beyond 64 bits they stay at the ends of long.  Without scale they are whole."""
    if scale is None:
        return column.flatten().to_numpy()
    flat = np.floor(column.flatten().to_numpy() * scale)
    out = np.clip(flat, -2.0**63, 2.0**62).astype(np.int64)
    if (large := flat >= 2.0**62).any():
        out[large] = [int(x) if x < 2.0**63 else LONG_MAX for x in flat[large]]
    return out


def _hashed(scale: int, keep_vectors: bool):
    """Length and hash of every vector, with its integers where ``keep_vectors``."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size = as_integers(batch.column(0), scale), batch.column(0).value_lengths().to_numpy()
            starts = np.cumsum(size) - size
            place = np.arange(len(x)) - np.repeat(starts, size)
            h = np.add.reduceat(kernel.mix(x.view(np.uint64)) * kernel.powers(int(size.max()) + 1)[place], starts)
            columns = {"d": pa.array(size, pa.int32()), "h": pa.array(kernel.as_long(kernel.mix(h)))}
            if keep_vectors:
                columns["x"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)), pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def products(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``x' * diag(weight) * x``, exactly: in floating point, 64-bit integers or unbounded ones as the values need."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    bound = most * most * max(1, int(np.abs(weight).max())) * len(x)
    if bound < 1 << 53:
        left = x.astype(np.float64)
        return ((left * weight[:, None]).T @ left).astype(np.int64).astype(object)
    kind = np.int64 if bound < 1 << 63 else object
    left = x.astype(kind)
    return ((left * weight.astype(kind)[:, None]).T @ left).astype(object)


def _scatter(dim: int, scale: int | None):
    """Upper triangle of the products of a task's vectors, each with a leading 1: count, sums and products.

    Entry ``k`` comes in parts of ``DIGITS`` bits, so that sums of any size stay exact; those that are zero are left out.
    """
    upper = np.triu_indices(dim + 1)

    def run(batches):
        second = np.zeros((dim + 1, dim + 1), object)
        for batch in batches:
            x = as_integers(batch.column(0), scale).reshape(-1, dim)
            w = batch.column(1).to_numpy()
            for i in range(0, len(x), ROWS):
                part = x[i:i + ROWS]
                second = second + products(np.column_stack([np.ones(len(part), np.int64), part]), w[i:i + ROWS])
        if second[0, 0]:
            out = [(k, part, digit if v > 0 else -digit) for k, v in enumerate(map(int, second[upper])) for part in range(-(-v.bit_length() // DIGITS))
                   if (digit := abs(v) >> (part * DIGITS) & ((1 << DIGITS) - 1))]
            yield pa.RecordBatch.from_pydict(dict(zip(("k", "part", "v"), map(list, zip(*out)))), pa.schema([("k", pa.int32()), ("part", pa.int32()), ("v", pa.int64())]))
    return run


def statistics(rows: DataFrame, copies: DataFrame, dim: int, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and products of the distinct vectors: those of all ``rows(v)`` less those of ``copies(x, extra)``."""
    columns = "k int, part int, v long"
    parts = arrow_map(rows.select("v", F.lit(1).cast("long").alias("w")), _scatter(dim, scale), columns).unionAll(
        arrow_map(copies.select("x", (-F.col("extra")).alias("w")), _scatter(dim, None), columns))
    sums = parts.groupBy("k", "part").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found: dict[int, int] = {}
    for r in sums.collect():  # (dim + 1) * (dim + 2) / 2 entries, whatever the table holds
        found[r.k] = found.get(r.k, 0) + (int(r.v) << (DIGITS * r.part))
    second = np.zeros((dim + 1, dim + 1), object)
    for k, (i, j) in enumerate(zip(*np.triu_indices(dim + 1))):
        second[i, j] = second[j, i] = found.get(k, 0)
    return second[0, 0], second[0, 1:].tolist(), second[1:, 1:].tolist()


# --- characteristic polynomial ---------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3.2e9."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all(pow(a, odd, n) == 1 or any(pow(a, odd << t, n) == n - 1 for t in range(twos)) for a in (2, 3, 5, 7))


def primes_for(bound: int) -> list[int]:
    """Primes below 2**31, largest first, whose product exceeds ``2 * bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of ``det(t - matrix)`` modulo a prime, constant first: Hessenberg form, then its recurrence."""
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    n = len(a)
    for m in range(1, n - 1):
        nonzero = np.flatnonzero(a[m:, m - 1])
        if not len(nonzero):
            continue
        if (i := m + int(nonzero[0])) != m:
            a[[i, m]] = a[[m, i]]
            a[:, [i, m]] = a[:, [m, i]]
        factor = a[m + 1:, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1:] = (a[m + 1:] - factor[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1:] * factor % p).sum(1)) % p
    poly = np.zeros((n + 1, n + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, n + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        weights, product = [int(a[k - 1, k - 1])], 1
        for j in range(k - 1, 0, -1):
            product = product * int(a[j, j - 1]) % p
            weights.append(product * int(a[j - 1, k - 1]) % p)
        poly[k] = (poly[k] - (np.array(weights)[:, None] * poly[k - 1::-1][:k] % p).sum(0)) % p
    return poly[n]


def _residues(matrix: list[list[int]]):
    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"p": pa.array([p]), "c": pa.array([polynomial_modulo(matrix, p).tolist()])})
    return run


def lift(residues: dict[int, list[int]]) -> list[int]:
    """Whole numbers of least size with the given residues."""
    product = math.prod(residues)
    out = [0] * len(next(iter(residues.values())))
    for p, rest in residues.items():
        others = product // p
        unit = others * pow(others % p, -1, p)
        out = [v + unit * r for v, r in zip(out, rest)]
    return [(v + product // 2) % product - product // 2 for v in out]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, constant first, of a matrix without negative eigenvalues; a few primes a task."""
    d = len(matrix)
    share = -(-sum(matrix[i][i] for i in range(d)) // d)  # e_k <= binom(d, k) * (trace / d)**k
    primes = primes_for(max(math.comb(d, k) * share**k for k in range(d + 1)))
    tasks = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    found = arrow_map(tasks, _residues(matrix), "p long, c array<long>").collect()  # bounded by the dimension and the digits of the trace
    return lift({r.p: list(r.c) for r in found})


# --- roots and components ----------------------------------------------------------------------

def roots_above(poly: list[int], a: int) -> int:
    """How many of the roots, all real, are larger than ``a``, with multiplicity: sign changes of ``poly(t + a)``."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, bits: int) -> list[tuple[int, int]]:
    """The largest positive roots as ``(r, multiplicity)``: each lies in ``(r - 1, r] / 2**bits``; ``poly`` is monic.

    Roots that share an interval of that width count as one of their joint multiplicity.  The last one may exceed ``count``.
    """
    d = len(poly) - 1
    scaled = [c << (bits * (d - k)) for k, c in enumerate(poly)]
    found, above, positive = [], 0, roots_above(scaled, 0)
    high = max(1, -scaled[d - 1])  # the sum of the roots
    while above < min(count, positive):
        low, below = 0, positive  # (low, high] holds the roots from number above + 1 to number below
        while high - low > 1:
            middle = (low + high) // 2
            if below == above + 1:  # a single root: the sign tells its side
                value = 0
                for c in reversed(scaled):
                    value = value * middle + c
                more = below if value and (value > 0) != (above % 2 == 0) else above
            else:
                more = roots_above(scaled, middle)
            if more > above:
                low, below = middle, more
            else:
                high = middle
        found.append((high, below - above))
        above, high = below, low
    return found


def null_space(matrix: list[list[int]], root: int, bits: int, size: int) -> list[list[int]]:
    """``size`` orthogonal vectors that ``matrix - root / 2**bits`` takes to almost zero, by inverse iteration in integers."""
    d, guard = len(matrix), 64
    a = [[((v << bits) - (root if i == j else 0)) << guard for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    rows = list(range(d))
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(a[r][k]))
        a[k], a[i], rows[k], rows[i] = a[i], a[k], rows[i], rows[k]
        a[k][k] = a[k][k] or 1
        for r in range(k + 1, d):
            if a[r][k]:
                f, pivot, up, row = a[r][k], a[k][k], a[k], a[r]
                for j in range(k + 1, d):
                    row[j] -= f * up[j] // pivot
    unit = 1 << (PRECISION + guard)

    def solve(b: list[int]) -> list[int]:
        y = [b[r] << (bits + 2 * guard) for r in rows]
        for k in range(d):
            for r in range(k + 1, d):
                if a[r][k]:
                    y[r] -= a[r][k] * y[k] // a[k][k]
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] - sum(a[k][j] * y[j] for j in range(k + 1, d))) // a[k][k]
        most = max(abs(v) for v in y) or 1
        return [v * unit // most for v in y]

    rng = np.random.default_rng(11)
    basis = [[int(v) * (unit >> 40) for v in rng.integers(-1 << 40, 1 << 40, d)] for _ in range(size)]
    for _ in range(60):
        basis = orthogonal([solve(v) for v in basis], unit)
        # a step away from the root is no larger than the interval allows
        worst = 0
        for v in basis:
            rest = [((sum(m * x for m, x in zip(row, v)) << bits) - root * v[i]) for i, row in enumerate(matrix)]
            worst = max(worst, max(abs(x) for x in rest) // max(1, max(abs(x) for x in v)))
        if worst <= 4 * d:
            break
    return basis


def orthogonal(vectors: list[list[int]], unit: int) -> list[list[int]]:
    out: list[list[int]] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                dot, norm = sum(x * y for x, y in zip(u, v)), sum(x * x for x in u)
                v = [y - x * dot // norm for x, y in zip(u, v)]
        most = max(abs(x) for x in v) or 1
        out.append([x * unit // most for x in v])
    return out


def directions(matrix: list[list[int]], poly: list[int], count: int) -> list[tuple[Fraction, list[float]]]:
    """The ``count`` largest eigenvalues with unit eigenvectors to double precision; zero eigenvalues have no vector."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    bits = max(0, PRECISION - trace.bit_length())
    out = []
    for root, size in largest_roots(poly, count, bits) if trace else []:
        for v in null_space(matrix, root, bits, size):
            norm = math.isqrt(sum(x * x for x in v))
            unit = [float(Fraction(x, norm)) for x in v]
            lead = max(range(len(unit)), key=lambda i: abs(unit[i]))
            out.append((Fraction(root, 1 << bits), unit if unit[lead] > 0 else [-x for x in unit]))
    return out[:count]


# --- result ----------------------------------------------------------------------------------

def _projected(n: int, total: list[int], weights: np.ndarray, dim: int, scale: int | None):
    """Deviation and whitened components of every vector."""
    most_total = max(map(abs, total))

    def run(batches):
        for batch in batches:
            x = as_integers(batch.column(1), scale).reshape(-1, dim)
            bound = max(int(x.max()), -int(x.min()), 0) * n + most_total if x.size else 0
            kind = np.int64 if dim * bound * bound < 1 << 63 else object
            centred = x.astype(kind) * n - np.array(total, kind)
            square = (centred * centred).sum(1)
            deviation = [v if v <= LONG_MAX else None for v in map(int, square)] if kind is object else square
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()), pa.array((centred.astype(np.float64) @ weights).tolist(), pa.list_(pa.float64()))],
                ["id", "deviation", "w"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``(<id_col>, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Entries c become ``floor(scale * c)`` as long, values beyond 64 bits the nearest long.  The distinct integer vectors are the fit
    list: ``n`` is their number, ``deviation`` the exact squared distance from their mean times ``n**2`` (null where it exceeds a long),
    ``whitened`` the projection on the component over the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace.
    ``identity_error`` is the largest entry of the fit list's covariance of ``whitened`` minus the identity.  Components beyond the rank
    have a null ``whitened`` and explain 0 (null where all vectors are equal); ``identity_error`` leaves them out and is
    null without any other.

    Null, empty, null-holding and non-finite vectors take no part, nor do vectors of another length than most rows have (ties: the
    greater length).  Repeated rows, repeated and null ids give rows of their own; other columns are not read.  An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    good = vectors.filter(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    hashes = materialize(arrow_map(good.select("v"), _hashed(scale, False), "d int, h long").groupBy("d", "h").agg(F.count("*").alias("m")), "vector-hashes")
    lengths = hashes.groupBy("d").agg(F.sum("m").alias("m")).orderBy(F.desc("m"), F.desc("d")).limit(1).collect()
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].d
    good = good.filter(F.size("v") == dim)
    whole = arrow_map(good.select("v"), _hashed(scale, True), "d int, h long, x array<long>")
    # equal vectors have equal hashes; those that may have copies are counted by their values
    repeated = hashes.filter((F.col("d") == dim) & (F.col("m") > 1)).select(F.col("h").alias("rh"))
    copies = materialize(maybe_member(whole, F.col("h"), repeated, F.col("rh")).groupBy("x").agg((F.count("*") - 1).alias("extra"))
                         .filter("extra > 0"), "vector-copies")
    n, total, second = statistics(good, copies, dim, scale)
    matrix = [[n * second[i][j] - total[i] * total[j] for j in range(dim)] for i in range(dim)]
    trace = sum(matrix[i][i] for i in range(dim))
    found = directions(matrix, characteristic_polynomial(spark, matrix), min(components, dim))
    # (n x - S) / n on the component, over sqrt(root / n**2)
    weights = np.array([[c / math.sqrt(root) for c in unit] for root, unit in found]).T.reshape(dim, len(found))
    project = lambda rows, by: arrow_map(rows, _projected(n, total, weights, dim, by), f"id {rows.dtypes[0][1]}, deviation long, w array<double>")
    wide = materialize(project(good.select("id", "v"), scale), "whitened")
    error = identity_error(wide, project(copies.select("extra", "x"), None), n, len(found))
    numbers = F.array(*[F.lit(i + 1) for i in range(min(components, dim))])
    share = F.array(*[F.lit(float(found[i][0] / trace) if i < len(found) else 0.0 if trace else None).cast("double") for i in range(min(components, dim))])
    flat = wide.select("id", "deviation", "w", F.explode(numbers).alias("component"))
    place = F.col("component") - 1
    return flat.select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", F.get("w", place).alias("whitened"),
        F.get(share, place).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def identity_error(wide: DataFrame, copies: DataFrame, n: int, k: int) -> float | None:
    """Largest entry of the covariance of ``w`` minus the identity over the fit list: all rows less the further copies."""
    if not k:
        return None
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    both = wide.select("w", F.lit(1.0).alias("m")).unionAll(copies.select("w", (-F.col("id")).cast("double").alias("m")))
    w = [F.get("w", F.lit(i)) for i in range(k)]
    mean = both.agg(*[F.sum(w[i] * F.col("m")).alias(f"a{i}") for i in range(k)]).first()
    centre = [w[i] - mean[i] / n for i in range(k)]
    sums = both.agg(*[F.sum(centre[i] * centre[j] * F.col("m")).alias(f"a{i}_{j}") for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(sums, pairs))
