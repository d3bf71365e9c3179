"""Whitening of exposure vectors through the exact characteristic polynomial of their scatter.

Components are whole units, so the scatter matrix ``n * Z'Z - S S'`` of the centred units is a
matrix of integers and is summed exactly. Its characteristic polynomial follows from Hessenberg
forms modulo many primes, one Spark row per prime, put together by Chinese remainders. All its
roots are real, so sign changes of shifted coefficients count the roots above a point exactly;
bisection isolates every root and refines it far beyond double precision. Each root's eigenvectors
come from inverse iteration in fixed-point arithmetic of as many bits as the distance to the next
root asks for, one Spark row per root. Only sums of the size of the matrix reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .vectors import taking_part

#: Bits of a limb, rows multiplied at once (products stay exact in doubles) and rows summed in a task before it emits.
LIMB, BATCH_ROWS, FLUSH_ROWS = 20, 1 << 12, 1 << 22
#: Units must stay below this to be longs.
LARGEST = 2.0 ** 62
#: Bits of a root beyond the first one and beyond the distance to its neighbours.
ROOT_BITS = 80


def _limbs(z: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of base 2**LIMB, least first; at least one."""
    out, half = [], 1 << (LIMB - 1)
    while not out or z.any():
        low = ((z + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        z = (z - low) >> LIMB
    return out


def _units(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.empty((0, 1), dtype=np.int64)


def _total(units: DataFrame, centre: list[int], products: bool) -> tuple[list[int], list[list[int]] | None]:
    """Exact sums of the centred units over all rows, and of their products."""
    d, middle = len(centre), np.array(centre, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[tuple[int, int], np.ndarray] = {}
        seen = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(lo, BATCH_ROWS)
                limbs = _limbs(_units(part.column(0), part.num_rows) - middle)
                for i, x in enumerate(limbs):
                    held[i, -1] = held.get((i, -1), 0) + x.sum(axis=0).astype(np.int64)
                    for j in range(i, len(limbs) if products else i):
                        held[i, j] = held.get((i, j), 0) + (x.T @ limbs[j]).astype(np.int64).ravel()
                seen += part.num_rows
                if seen >= FLUSH_ROWS:
                    yield _rows(held)
                    held, seen = {}, 0
        yield _rows(held)

    def _rows(sums):
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                           pa.array([sums[k].tolist() for k in keys], pa.list_(pa.int64()))], ["a", "b", "sums"])

    parts = units.select("units").mapInArrow(run, "a int, b int, sums array<long>").select("a", "b", F.posexplode("sums").alias("at", "value"))
    found = parts.groupBy("a", "b", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # a row per cell of the matrix and limb pair
    sums, square = [0] * d, [[0] * d for _ in range(d)]
    for a, b, at, value in found:
        if b < 0:
            sums[at] += int(value) << (LIMB * a)
        else:
            i, j = divmod(at, d)
            square[i][j] += int(value) << (LIMB * (a + b))
            if a != b:
                square[j][i] += int(value) << (LIMB * (a + b))
    return sums, square if products else None


def primes_below(top: int) -> Iterator[int]:
    """Odd primes below ``top`` (at most 2**32), greatest first."""
    for n in range((top - 1) | 1, 2, -2):
        if n >= top:
            continue
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 7, 61):
            x = pow(base, odd, n)
            if base % n == 0 or x in (1, n - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                break
        else:
            yield n


def modular_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, highest first, of det(x - matrix) modulo the prime p, by a Hessenberg form."""
    h = matrix.copy() % p
    n = len(h)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), dtype=np.int64)  # row m: lowest first
    polys[0, 0] = 1
    for m in range(1, n + 1):
        polys[m, 1:] = polys[m - 1, :-1]
        weights, chain = np.zeros(m, dtype=np.int64), 1
        weights[m - 1] = h[m - 1, m - 1]
        for i in range(m - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            weights[i] = chain * int(h[i, m - 1]) % p
        polys[m] = (polys[m] - (weights[:, None] * polys[:m] % p).sum(axis=0)) % p
    return polys[n, ::-1].tolist()


def _root_bound(trace: int, d: int) -> int:
    """Greatest possible coefficient of a polynomial with ``d`` roots from 0 on whose sum is ``trace``."""
    return max(math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))


def _joined(images: list[tuple[int, list[int]]]) -> list[int]:
    """Coefficients of least absolute value by Chinese remainders."""
    modulus, out = 1, [0] * len(images[0][1])
    for p, image in images:
        inverse = pow(modulus % p, -1, p)
        out = [c + modulus * ((r - c) * inverse % p) for c, r in zip(out, image)]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in out]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients, highest first, for a symmetric matrix without negative roots."""
    need, chosen, product = 4 * _root_bound(sum(row[i] for i, row in enumerate(matrix)), len(matrix)), [], 1
    for p in primes_below(1 << 31):
        chosen.append(p)
        product *= p
        if product > need:
            break
    shared = spark.sparkContext.broadcast(matrix)  # d x d integers

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                image = modular_polynomial(np.array([[x % p for x in row] for row in shared.value], dtype=np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([image], pa.list_(pa.int64()))], ["prime", "image"])

    tasks = max(1, min(len(chosen), spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(p,) for p in chosen], "prime long").repartition(tasks, "prime")
    return _joined([(r.prime, r.image) for r in table.mapInArrow(run, "prime long, image array<long>").collect()])


def _gcd_mod(a: list[int], b: list[int], p: int) -> list[int]:
    """Monic greatest common divisor of two polynomials modulo p."""
    def trimmed(x):
        at = next((i for i, c in enumerate(x) if c % p), len(x))
        return [c % p for c in x[at:]]

    a, b = trimmed(a), trimmed(b)
    while b:
        inverse = pow(b[0], -1, p)
        while len(a) >= len(b):
            f = a[0] * inverse % p
            a = trimmed([(c - f * (b[i] if i < len(b) else 0)) for i, c in enumerate(a)])
        a, b = b, a
    inverse = pow(a[0], -1, p)
    return [c * inverse % p for c in a]


def _divided(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder by a monic polynomial."""
    a, out = list(a), []
    for i in range(len(a) - len(b) + 1):
        f = a[i]
        out.append(f)
        if f:
            for j, c in enumerate(b):
                a[i + j] -= f * c
    return out, a[len(out):]


def distinct_part(poly: list[int]) -> list[int]:
    """The monic polynomial with the same roots, each once."""
    slope = [c * (len(poly) - 1 - i) for i, c in enumerate(poly[:-1])]
    images: list[tuple[int, list[int]]] = []
    for p in primes_below(1 << 31):
        image = _gcd_mod(poly, slope, p)
        if len(image) == 1:
            return poly
        if images and len(image) > len(images[0][1]):
            continue  # an unlucky prime
        if images and len(image) < len(images[0][1]):
            images = []
        images.append((p, image))
        common = _joined(images)
        found, rest = _divided(poly, common)
        if not any(rest) and not any(_divided(slope, common)[1]):
            return found
    raise AssertionError("primes ran out")


def roots_above(poly: list[int], at: int, shift: int) -> int:
    """Roots above ``at / 2**shift``, counted as often as they occur, of a polynomial with real roots only."""
    c = [x << (shift * i) for i, x in enumerate(poly)]  # roots times 2**shift
    n = len(c)
    for i in range(n - 1):
        for j in range(1, n - i):
            c[j] += at * c[j - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int, shift: int) -> int:
    value, scale = 0, 0
    for c in poly:
        value = value * at + (c << scale)
        scale += shift
    return (value > 0) - (value < 0)


def positive_roots(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """(``at``, ``shift``, times) of the largest positive roots ``at / 2**shift``, falling, until ``most`` are counted.

    A root is within 2**-ROOT_BITS of ``at / 2**shift`` relative to the greatest root and to the
    distance of its neighbours.
    """
    while poly and poly[-1] == 0:
        poly = poly[:-1]
    if len(poly) < 2:
        return []
    top = 1 << (-poly[1]).bit_length()  # above the sum of the roots
    single = distinct_part(poly)
    stack, isolated, counted = [(0, top, 0, len(single) - 1, 0)], [], 0  # (low, high], shift, roots above low and high
    while stack:
        low, high, shift, above_low, above_high = stack.pop()
        if above_low == above_high:
            continue
        if above_low - above_high == 1 and low > 0:
            isolated.append((low, high, shift))
            if counted >= most:
                break  # the first root that is left out, a neighbour of the last one
            counted += roots_above(poly, low, shift) - roots_above(poly, high, shift)
            continue
        if high - low == 1:
            low, high, shift = low << 16, high << 16, shift + 16
        middle = (low + high) // 2
        above = roots_above(single, middle, shift)
        stack.append((low, middle, shift, above_low, above))
        stack.append((middle, high, shift, above, above_high))
    # Bits after the point: first by the size of a root, then by the distance of its neighbours.
    fine = [_refined(single, root, ROOT_BITS + root[2] - root[0].bit_length()) for root in isolated]
    places = max(0, *(shift for _, _, shift in fine)) + 1
    while True:
        points = [high << (places - shift) if places >= shift else high >> (shift - places) for _, high, shift in fine] + [0]
        gaps = [a - b for a, b in zip(points, points[1:])]
        if min(gaps) > 4:
            break
        places *= 2
        fine = [_refined(single, root, places + 1) for root in fine]
    out, counted = [], 0
    for i, root in enumerate(fine):
        if counted >= most:
            break
        near = min(gaps[max(0, i - 1):i + 1])
        low, high, shift = _refined(single, root, ROOT_BITS + places - near.bit_length() + 1)
        times = roots_above(poly, isolated[i][0], isolated[i][2]) - roots_above(poly, isolated[i][1], isolated[i][2])
        out.append((high, shift, times))
        counted += times
    return out


def _refined(poly: list[int], root: tuple[int, int, int], places: int) -> tuple[int, int, int]:
    """The interval of a single root cut down to a width of 2**-places."""
    low, high, shift = root
    if places > shift:
        low, high, shift = low << (places - shift), high << (places - shift), places
    rising = _sign(poly, high, shift)
    while rising and high - low > 1:
        middle = (low + high) // 2
        sign = _sign(poly, middle, shift)
        if sign == 0:
            return middle - 1, middle, shift
        low, high = (low, middle) if sign == rising else (middle, high)
    return (low, high, shift) if rising else (high - 1, high, shift)


def eigenvectors(matrix: list[list[int]], at: int, shift: int, times: int, bits: int) -> np.ndarray:
    """Unit vectors (rows) of the eigenvalue ``at / 2**shift`` that occurs ``times`` times, by inverse iteration
    in fixed-point arithmetic of ``bits`` bits below the largest entry."""
    d = len(matrix)
    unit = max(1, max(abs(x) for row in matrix for x in row)).bit_length()
    down = bits - unit
    fixed = lambda x, s: (x << (down - s)) if down >= s else (x >> (s - down))
    a = np.array([[fixed((x << shift) - at if i == j else x, shift if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
    rng = np.random.default_rng(17)
    b = np.array([[int(x) << bits for x in row] for row in rng.integers(-999, 1000, (d, times)) * 2 + 1], dtype=object)
    a = np.hstack([a, b])
    for i in range(d):  # rows with the largest pivot first
        best = i + max(range(d - i), key=lambda r: abs(a[i + r, i]))
        if best != i:
            a[[i, best]] = a[[best, i]]
        if a[i, i] == 0:
            a[i, i] = 1  # the eigenvalue itself: one step of the last place
        if i + 1 < d:
            factor = np.array([(x << bits) // a[i, i] for x in a[i + 1:, i]], dtype=object)
            a[i + 1:, i:] -= (factor[:, None] * a[i, i:][None, :]) >> bits
    y = np.zeros((d, times), dtype=object)
    for i in range(d - 1, -1, -1):
        rest = a[i, d:] << bits
        if i + 1 < d:
            rest = rest - (a[i, i + 1:d][:, None] * y[i + 1:]).sum(axis=0)
        y[i] = rest // a[i, i]
    columns = []
    for j in range(times):
        largest = max(1, max(abs(x) for x in y[:, j]).bit_length())
        cut = max(0, largest - 900)
        columns.append([math.ldexp(float(int(x) >> cut), -min(largest, 900)) for x in y[:, j]])
    q, _ = np.linalg.qr(np.array(columns).T)
    return q.T


def _components(spark, matrix: list[list[int]], roots: list[tuple[int, int, int]]) -> list[tuple[int, np.ndarray]]:
    """The vectors of every root, one Spark row per root."""
    shared = spark.sparkContext.broadcast(matrix)  # d x d integers

    def run(batches):
        for batch in batches:
            for number, at, shift, times in zip(*(c.to_pylist() for c in batch.columns)):
                precision = shift + max(1, max(abs(x) for row in shared.value for x in row)).bit_length() + 2 * ROOT_BITS
                vectors = eigenvectors(shared.value, int(at), shift, times, precision)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([vectors.ravel().tolist()], pa.list_(pa.float64()))], ["number", "vectors"])

    tasks = max(1, min(len(roots), spark.sparkContext.defaultParallelism))
    rows = [(i, str(at), shift, times) for i, (at, shift, times) in enumerate(roots)]
    table = spark.createDataFrame(rows, "number long, at string, shift long, times long").repartition(tasks, "number")
    found = {r.number: np.array(r.vectors).reshape(-1, len(matrix)) for r in table.mapInArrow(run, "number long, vectors array<double>").collect()}
    return [(i, found[i]) for i in range(len(roots))]


def whitened_exposures(exposures: DataFrame, *, components: int = 32, scale: int = 64, id_col: str = "ts_code",
                       features_col: str = "features") -> DataFrame:
    """Factor exposures of every stock on unit-variance, uncorrelated components: ``ts_code``, ``component`` (from 1
    by falling variance), ``n`` rows of the fit list, ``deviation`` (decimal(38,0): sum over the features of
    ``(n * x - S)**2``), ``whitened``, ``explained`` (share of all variance) and ``identity_error`` (largest absolute
    entry of the covariance of ``whitened`` minus the identity; one value).

    A feature counts as the whole number ``x = floor(scale * feature)``, plus any constant, which changes no column
    of the result; ``S`` are the sums of x. Rows
    whose features are null, empty, of an uncommon length (the shorter one of a tie is common) or hold a null or
    non-finite entry take no part; all others are fitted and returned, repeated rows and null codes included.
    Components are eigenvectors of x's covariance (divisor n); those without variance are left out, so equal
    rows only, a single row and an empty table give no rows. Components of equal variance are one orthonormal
    basis of their space. Further columns are ignored, whatever their names. Entries so large that ``x`` is no
    long are an error.
    """
    vec = F.transform(exposures[features_col], lambda x: x.cast("double"))
    rows = taking_part(exposures.select(exposures[id_col].alias("code"), vec.alias("vec")))
    whole = F.transform("vec", lambda x: F.floor(F.when(F.abs(x) * scale < LARGEST, x * scale).otherwise(F.raise_error(F.lit("a feature is too large for whole units")))))
    units = cut_lineage(rows.select("code", whole.cast("array<long>").alias("units")))
    spark, kind = units.sparkSession, units.schema["code"].dataType
    n, width = units.agg(F.count(F.lit(1)), F.max(F.size("units"))).first()
    schema = T.StructType([T.StructField("code", kind), T.StructField("component", T.IntegerType()), T.StructField("deviation", T.StringType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])
    basis: list[tuple[float, np.ndarray]] = []
    sums: list[int] = []
    if n:
        sums, _ = _total(units, [0] * width, products=False)
        centre = [(2 * s + n) // (2 * n) for s in sums]
        rest, square = _total(units, centre, products=True)
        scatter = [[n * square[i][j] - rest[i] * rest[j] for j in range(width)] for i in range(width)]  # n**2 times the covariance
        common = math.gcd(*(x for row in scatter for x in row))
        if common:
            matrix = [[x // common for x in row] for row in scatter]
            trace = sum(matrix[i][i] for i in range(width))
            roots = positive_roots(characteristic_polynomial(spark, matrix), components)
            for number, vectors in _components(spark, matrix, roots):
                at, places, _ = roots[number]
                basis += [(at, places, v) for v in vectors]
    basis = basis[:components]
    if not basis:
        out = spark.createDataFrame([], schema).withColumn("identity_error", F.lit(0.0))
        return _named(out, n, id_col)
    # Standard deviation of n * x - S along a component is the square root of its root times the common factor.
    spread = [math.sqrt((common * at) >> places) if (common * at) >> places > 1 << 60 else math.sqrt(common * at / (1 << places)) for at, places, _ in basis]
    turned = np.array([v for _, _, v in basis]).T / np.array(spread)
    explained = np.array([at / (trace << places) for at, places, _ in basis])
    fitted = spark.sparkContext.broadcast((n, sums, turned, explained))  # width x components doubles

    def centred(part):
        """(exact ``n * x - S`` as doubles, texts of its squared length) of the rows."""
        z, (count, totals, _, _) = _units(part.column(1), part.num_rows), fitted.value
        largest = max(1, int(np.abs(z).max(initial=0))) * count + max(abs(s) for s in totals)
        if largest * largest * len(totals) < 1 << 62:
            whole_ = z * np.int64(count) - np.array(totals, dtype=np.int64)
            return whole_.astype(np.float64), [str(x) for x in (whole_ * whole_).sum(axis=1).tolist()]
        exact = z.astype(object) * count - np.array(totals, dtype=object)
        return exact.astype(np.float64), [str(sum(x * x for x in row)) for row in exact]

    def covariance(batches):
        held = np.zeros((len(basis), len(basis)))
        means = np.zeros(len(basis))
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                w = centred(batch.slice(lo, BATCH_ROWS))[0] @ fitted.value[2]  # centred already
                held += w.T @ w
                means += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel().tolist() + means.tolist()], pa.list_(pa.float64()))], ["sums"])

    cells = units.mapInArrow(covariance, "sums array<double>").select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(len(basis) * (len(basis) + 1))
    for r in cells:  # components x components sums
        flat[r["at"]] = r["value"] / n
    mean = flat[len(basis) ** 2:]
    error = float(np.abs(flat[:len(basis) ** 2].reshape(len(basis), -1) - np.outer(mean, mean) - np.eye(len(basis))).max())

    def project(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(lo, BATCH_ROWS)
                x, deviation = centred(part)
                w, k = x @ fitted.value[2], len(basis)
                at = np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                                                  pa.array(deviation).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(fitted.value[3], part.num_rows))], schema.names)

    return _named(units.mapInArrow(project, schema).withColumn("identity_error", F.lit(error)), n, id_col)


def _named(out: DataFrame, n: int, id_col: str) -> DataFrame:
    return out.select(F.col("code").alias(id_col), "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
                      "whitened", "explained", "identity_error")
