"""Whitening of embeddings by blockwise QR and a bidiagonal qd solver.

Every task reduces its centred rows to a triangular factor, and the factors of
``FAN_IN`` tasks at a time are stacked and reduced again until one is left: its
right singular vectors are those of all rows.  No row is squared on the way, so
small variances keep their digits.  The one factor (dimensions squared, whatever
the number of rows) is brought to bidiagonal form by Householder reflections;
the differential qd algorithm with shifts finds its singular values to high
relative accuracy, and a twisted factorisation per value gives its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices, stored

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
FAN_IN = 32
EPS = np.finfo(float).eps
#: Relative distance below which singular values count as one cluster.
CLUSTER = 1e-7
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# ---- the triangular factor ---------------------------------------------------

def reduced(rows: np.ndarray) -> np.ndarray:
    """Upper triangular factor of a block of rows."""
    return np.linalg.qr(rows, mode="r")


def _triangles(rows: DataFrame, blocks: Callable[[pa.RecordBatch], np.ndarray], dims: int) -> DataFrame:
    """(at, factor): per task the triangular factor of its rows, folded block by block."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        factor, at = np.empty((0, dims)), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                block = blocks(part)
                if len(block):
                    factor = reduced(np.vstack([factor, block]))
        if len(factor):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([factor.tobytes()])], names=["at", "factor"])

    return rows.mapInArrow(fold, "at bigint, factor binary")


def triangle(rows: DataFrame, blocks: Callable[[pa.RecordBatch], np.ndarray], dims: int) -> np.ndarray:
    """Triangular factor of all rows: FAN_IN factors meet in a task, in as many rounds as their number needs."""

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        factors = table.column("factor").to_pylist()
        stack = np.vstack([np.frombuffer(factors[i]).reshape(-1, dims) for i in order])
        return pa.table({"at": [int(table.column("at")[0].as_py()) // FAN_IN], "factor": pa.array([reduced(stack).tobytes()], pa.binary())})

    factors, parts = _triangles(rows, blocks, dims), rows.rdd.getNumPartitions()
    while parts > 1:
        factors = factors.groupBy(F.expr(f"at div {FAN_IN}")).applyInArrow(merge, "at bigint, factor binary")
        parts = -(-parts // FAN_IN)
    found = [np.frombuffer(r["factor"]).reshape(-1, dims) for r in factors.collect()]  # one factor, or none
    return reduced(np.vstack([*found, np.zeros((dims, dims))]))


# ---- bidiagonal form and its singular values ---------------------------------

def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit vector whose reflection maps x to a multiple of the first axis; None if x lies there."""
    if not x[1:].any():
        return None
    v = x / np.abs(x).max()
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right factor): a = left @ B @ right.T, right orthogonal."""
    a, size = a.copy(), a.shape[1]
    right = np.eye(size)
    for k in range(size):
        if (v := _reflector(a[k:, k])) is not None:
            a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k < size - 2 and (v := _reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, 2 * v)
            right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, 2 * v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step; None if the shift exceeds the smallest value."""
    q_next, e_next, d, least = [], [], q[0] - shift, q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        ratio = q[k + 1] / top if top > 0 else 0.0
        q_next.append(top)
        e_next.append(e[k] * ratio)
        d = (d * ratio if top > 0 else q[k + 1]) - shift
        least = min(least, d)
    return None if d < 0 else ([*q_next, d], e_next, least)


def qd_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, by the shifted differential qd algorithm."""
    values: list[float] = []
    blocks = [((diagonal * diagonal).tolist(), (above * above).tolist(), 0.0)]
    while blocks:
        q, e, sigma = blocks.pop()
        least, sweeps = 0.0, 0
        while q:
            cut = next((k for k in reversed(range(len(e))) if e[k] <= EPS * EPS * (sigma + min(q[k], q[k + 1]))), None)
            if len(q) == 1 or cut == len(e) - 1:
                values.append(sigma + q.pop())
                if e:
                    e.pop()
                continue
            if cut is not None:  # the parts have nothing to do with each other any more
                blocks.append((q[: cut + 1], e[:cut], sigma))
                q, e, least = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            # the last two rows bound the smallest value from above, as does the last sweep's least pivot
            low, high, off = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = (low - high) / 2
            corner = high - off / (half + np.copysign(np.hypot(half, np.sqrt(off)), half)) if off else min(low, high)
            shift = max(0.0, min(least, corner) * (1 - 4 * EPS))
            for attempt in (shift, shift / 2, shift / 8, 0.0):
                step = _dqds(q, e, attempt)
                if step is not None:
                    q, e, least = step
                    sigma += attempt
                    break
            sweeps += 1
            if sweeps > 100 * (len(q) + 10):
                raise ArithmeticError("the qd algorithm did not converge")
    return np.sort(np.array(values))[::-1]


# ---- vectors by twisted factorisation ----------------------------------------

def _pivot(x: float, least: float) -> float:
    return x if abs(x) >= least else np.copysign(least, x)


def _factors(d: np.ndarray, low: np.ndarray, value: float, least: float) -> tuple[np.ndarray, ...]:
    """Top-down and bottom-up factors of L D L' - value, and the residual of joining them at each row.

    Pivots are kept at ``least`` in size.
    """
    size = d.size
    down, up = np.empty(size), np.empty(size)
    lower, upper = np.empty(size - 1), np.empty(size - 1)
    s, p = np.empty(size), np.empty(size)
    s[0] = -value
    for k in range(size - 1):
        down[k] = _pivot(s[k] + d[k], least)
        lower[k] = d[k] * low[k] / down[k]
        s[k + 1] = lower[k] * low[k] * s[k] - value
    down[-1] = _pivot(s[-1] + d[-1], least)
    p[-1] = d[-1] - value
    for k in reversed(range(size - 1)):
        up[k + 1] = _pivot(d[k] * low[k] ** 2 + p[k + 1], least)
        ratio = d[k] / up[k + 1]
        upper[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    return down, lower, upper, s + p + value


def twisted_vector(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of L D L' for ``value``, from the twist whose residual is least."""
    _, lower, upper, gamma = _factors(d, low, value, np.finfo(float).tiny ** 0.5)
    twist = int(np.nanargmin(np.abs(gamma)))
    z = np.zeros(d.size)
    z[twist] = 1.0
    for k in reversed(range(twist)):
        z[k] = -lower[k] * z[k + 1]
    for k in range(twist, d.size - 1):
        z[k + 1] = -upper[k] * z[k]
    return z / np.linalg.norm(z)


def _solved(d: np.ndarray, low: np.ndarray, value: float, b: np.ndarray) -> np.ndarray:
    """Direction of (L D L' - value)^-1 b."""
    down, lower, _, _ = _factors(d, low, value, EPS * float(np.abs(d).max()))
    x = b.copy()
    for k in range(d.size - 1):
        x[k + 1] -= lower[k] * x[k]
    x /= down
    for k in reversed(range(d.size - 1)):
        x[k] -= lower[k] * x[k + 1]
    return x / np.linalg.norm(x)


def principal(factor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): largest squared singular values of a triangular factor and their right vectors.

    Values that are nothing but rounding are left out.  Values of one cluster
    share their directions: further vectors of a cluster come from inverse
    iteration and are kept orthogonal to those before them.  Each vector's
    largest entry is positive.
    """
    size = factor.shape[1]
    scale = float(np.abs(factor).max(initial=0.0))
    if scale == 0.0:
        return np.empty(0), np.empty((size, 0))
    diagonal, above, right = bidiagonal(factor / scale)
    values = qd_values(diagonal, above)
    values = values[values > values[0] * (size * EPS) ** 2][:most]
    safe = np.where(np.abs(diagonal) < EPS * np.abs(diagonal).max(), EPS * np.abs(diagonal).max(), diagonal)
    d, low = safe * safe, above / safe[:-1]
    rng, vectors, near = np.random.default_rng(0), np.empty((size, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * values[j - 1]:
            near = j
        if near == j:
            z = twisted_vector(d, low, value)
        else:
            z = rng.standard_normal(size)
            for _ in range(4):
                z = _solved(d, low, value, z)
                for _ in range(2):
                    z -= vectors[:, near:j] @ (vectors[:, near:j].T @ z)
                    z /= np.linalg.norm(z)
        vectors[:, j] = z
    vectors = right @ vectors
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values * scale * scale, vectors * signs


# ---- rows --------------------------------------------------------------------

def entries(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the usable vectors of ``dims`` entries and where they stand; without dims, their lengths."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    flat = column.values.slice(column.offsets[0].as_py(), int(lengths.sum())) if len(column) else pa.array([], pa.float64())
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    ends = np.cumsum(lengths)
    usable = (bad[ends] == bad[ends - lengths]) & (lengths > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    if dims is None:
        return np.flatnonzero(usable), lengths[usable]
    rows = np.flatnonzero(usable & (lengths == dims))
    return rows, numbers[(ends[rows] - dims)[:, None] + np.arange(dims)] if rows.size else np.empty((0, dims))


def whole_numbers(matrix: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 of each entry."""
    return np.floor(SCALE * matrix).astype(np.int64) + OFFSET


def exact_squares(rows: np.ndarray) -> np.ndarray:
    """Sum of squares of each row of whole numbers as Python or machine integers, without overflow."""
    if rows.size and float(np.abs(rows).max()) ** 2 * rows.shape[1] < 2.0**62:
        return (rows * rows).sum(axis=1)
    return (rows.astype(object) ** 2).sum(axis=1)


def _sums(vectors: DataFrame) -> DataFrame:
    """(dims, n, sums): per task and vector length, rows and exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for part in slices(batch):
                for dims in np.unique(entries(part.column("embedding"))[1]).tolist():
                    x = whole_numbers(entries(part.column("embedding"), dims)[1])
                    held = seen.setdefault(dims, [0, np.zeros(dims, np.int64)])
                    held[0] += len(x)
                    held[1] += x.sum(axis=0)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int32()), pa.array([v[0] for v in seen.values()], pa.int64()),
                 pa.array([v[1].tolist() for v in seen.values()], pa.list_(pa.int64()))], names=["dims", "n", "sums"])

    return vectors.mapInArrow(run, "dims int, n bigint, sums array<bigint>")


def _moments(vectors: DataFrame, whitened: Callable[[pa.RecordBatch], np.ndarray], width: int, n: int) -> np.ndarray:
    """Covariance of the whitened columns: centred in each task, then between tasks (divisor n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, spread = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for part in slices(batch):
                block = whitened(part)
                if not len(block):
                    continue
                own = block.mean(axis=0)
                centred, apart, total = block - own, own - mean, count + len(block)
                spread += centred.T @ centred + np.outer(apart, apart) * (count * len(block) / total)
                mean, count = mean + apart * (len(block) / total), total
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([count]), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], names=["n", "mean", "spread"])

    tasks = stored(vectors.mapInArrow(run, "n bigint, mean array<double>, spread array<double>"), "moments")
    places = range(width)
    mean = tasks.agg(*[F.sum(F.col("n") * F.col("mean")[i]).alias(f"m{i}") for i in places]).first()
    apart = [F.col("mean")[i] - F.lit(mean[i] / n) for i in places]
    both = tasks.agg(*[F.sum(F.col("spread")[i * width + j] + F.col("n") * apart[i] * apart[j]).alias(f"c{i}_{j}") for i in places for j in range(i + 1)]).first()
    out = np.empty((width, width))
    for i in places:
        for j in range(i + 1):
            out[i, j] = out[j, i] = both[f"c{i}_{j}"] / n
    return out


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable vector along the leading principal directions.

    A vector that is null, empty, or holds null or non-finite entries is left
    out, as is one that has not the commonest length (ties: the shorter).  Any
    number of dimensions works as long as its square fits the driver; entries
    are expected below 2**40 in size.  Directions without variance have no
    whitened coordinate and no row, so vectors that are all equal, a single
    vector and an empty table give no rows.  Equal eigenvalues get any
    orthonormal directions of theirs, the same for all rows.  Repeated rows
    each count and each get their rows; a null key stays null; further columns
    are ignored.  ``deviation`` is null where it does not fit 64 bits.
    """
    spark = rows.sparkSession
    vectors = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    tasks = stored(_sums(vectors.select("embedding")), "sums")
    common = tasks.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    dims, n = common["dims"], common["n"]
    totals = tasks.where(F.col("dims") == dims).select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(dims, np.int64)
    for r in totals:
        sums[r["at"]] = r["v"]
    mean = sums / n

    def centred(part: pa.RecordBatch) -> np.ndarray:
        return whole_numbers(entries(part.column("embedding"), dims)[1]) - mean

    factor = triangle(vectors.select("embedding"), centred, dims)
    values, directions = principal(factor, components)
    width = len(values)
    if width == 0:
        return spark.createDataFrame([], SCHEMA)
    scaled = directions / np.sqrt(values / n)
    explained = values / float((factor * factor).sum())
    covariance = _moments(vectors.select("embedding"), lambda part: centred(part) @ scaled, width, n)
    error = float(np.abs(covariance - np.eye(width)).max())

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 << 63) - 1
        for batch in batches:
            for part in slices(batch):
                at, matrix = entries(part.column("embedding"), dims)
                if not at.size:
                    continue
                x = whole_numbers(matrix)
                size = [int(v) if v <= most else None for v in exact_squares(n * x - sums)]
                repeated = np.repeat(np.arange(at.size), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(at[repeated])), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), at.size)),
                     pa.array(np.full(repeated.size, n)), pa.array(size, pa.int64()).take(pa.array(repeated)),
                     pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, at.size)), pa.array(np.full(repeated.size, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(report, SCHEMA)
