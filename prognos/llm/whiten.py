"""Whitening of embeddings along principal components that QDWH spectral divide-and-conquer finds.

Counts, sums and the centred covariance are gathered by Spark, a matrix of partial sums for each task. The decomposition itself is
of one matrix with as many rows as vectors have entries: the polar factor U of the covariance shifted by a point inside its spectrum
has eigenvalues 1 and -1, so (U + I) / 2 projects onto the eigenvectors above the shift; bases of the two subspaces split the
matrix in two, and each part is split again until parts are single components. The polar factor comes from dynamically weighted
Halley steps, which need only QR factors, Cholesky factors and products. Rows are then projected where they are; what is
broadcast is the mean and the components asked for, as many numbers as the vectors have entries, each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import integer_vectors, prepare, stored
from prognos.llm.neardup import matrix

#: Relative size under which an off-diagonal block counts as zero and an eigenvalue as none.
TOLERANCE = 64 * np.finfo(float).eps
#: Shifts tried for one split.
SHIFTS = 12


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without zero eigenvalues, by dynamically weighted Halley steps."""
    n, eye = len(a), np.eye(len(a))
    x = a / np.linalg.norm(a)
    low = min(1.0, 1 / np.linalg.norm(np.linalg.inv(x)))  # at most the smallest singular value
    for _ in range(60):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        top = math.sqrt(1 + d) + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d))))
        b = (top - 1) ** 2 / 4
        c = top + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, eye]))
            new = b / c * x + (top - b / c) / math.sqrt(c) * q[:n] @ q[n:].T
        else:
            factor = np.linalg.cholesky(eye + c * x.T @ x)
            new = b / c * x + (top - b / c) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (top + b * low**2) / (1 + c * low**2))
        if 1 - low < 1e-14 and moved < 1e-9:
            break
    return x


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a point of the spectrum; None if all eigenvalues are one.

    The point is the median of the diagonal; if it meets an eigenvalue or splits nothing, the mean and points near it are tried.
    """
    m, eye = len(a), np.eye(len(a))
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * eye)
    if m == 1 or spread <= TOLERANCE * scale:
        return None
    best, least = None, math.inf
    for t in range(SHIFTS):
        shift = np.median(np.diag(a)) if t == 0 else mean + (0 if t == 1 else (-1) ** t * spread / m * (t // 2) / SHIFTS)
        try:
            projector = (polar(a - shift * eye) + eye) / 2
        except np.linalg.LinAlgError:
            continue
        k = int(round(np.trace(projector)))
        if not 0 < k < m:
            continue
        # the columns of largest norm after a subspace step span the projector's range; complete QR gives the complement
        start = projector[:, np.argsort(-np.diag(projector), kind="stable")[:k]]
        basis, _ = np.linalg.qr(projector @ np.linalg.qr(start + projector @ np.random.RandomState(t).standard_normal((m, k)))[0], mode="complete")
        upper, lower = basis[:, :k], basis[:, k:]
        rest = np.linalg.norm(lower.T @ a @ upper)
        if rest < least:
            best, least = (upper, lower), rest
        if rest <= TOLERANCE * scale:
            break
    return best


def components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Upper subspaces are split first, and none that lies below the k-th component. Components of equal eigenvalues are any orthonormal ones.
    """
    scale, found = np.linalg.norm(a), []
    parts = [np.eye(len(a))]
    while parts and len(found) < k:
        basis = parts.pop()
        inner = basis.T @ a @ basis
        halves = split((inner + inner.T) / 2, scale)
        if halves is None:
            found += [(v @ a @ v, v) for v in basis.T]
        else:
            parts += [basis @ halves[1], basis @ halves[0]]
    found = sorted(found, key=lambda f: -f[0])[:k]
    return np.array([f[0] for f in found]), np.array([f[1] for f in found]).T.reshape(len(a), -1)


def _totals(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows x of what `part` makes of matrices of them (matrix to matrix), gathered by row and column of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = part(matrix(batch.column("x")))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64() if kind == "double" else pa.int64()))], ["i", "v"])

    cells = df.select("x").mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    rows = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # one row for each cell of a matrix over the entries
    out = np.zeros((1 + max((r.i for r in rows), default=-1), 1 + max((r.j for r in rows), default=-1)), np.float64 if kind == "double" else np.int64)
    for r in rows:
        out[r.i, r.j] = r.v
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a vector of finite entries, for the first k components.

    A row's entries become the integers x = floor(scale * entry); a shorter vector counts as filled with zeros. The covariance is of
    the distinct x, each once, so copies don't weigh: n of them with sums S. deviation is the sum of (n x - S)^2 over the entries, a
    decimal(38,0); whitened is x - S/n projected on the component, over the root of its eigenvalue; explained is the eigenvalue's
    share of the trace. A component without variance has no whitened value (null), and explained is null where nothing varies.
    identity_error is the largest entry by which whitened's covariance over the distinct x departs from the identity, null if
    there is no whitened value. Rows without a key, and repeated ones, are each answered; vectors with null or non-finite entries, and an
    empty table, give no rows; vectors with fewer entries than k have as many components as entries.
    """
    prepare(vectors.sparkSession)
    rows = integer_vectors(vectors.select(F.col(key).alias(key), F.col(vector).alias("x")), "x", scale)
    rows = stored(rows, "integers")
    (dim,) = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    filled = F.when(F.size("x") < dim, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))).otherwise(F.col("x"))
    kind = vectors.schema[key].dataType
    out_columns = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if dim == 0:
        empty = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.where("false").select(key, *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    rows = rows.withColumn("x", filled)
    distinct = stored(rows.select("x").distinct(), "distinct")
    sums = _totals(distinct, lambda x: np.vstack([x.astype(np.int64).sum(0), np.full(x.shape[1], len(x))]), "long")
    s, n = [int(v) for v in sums[0]], int(sums[1, 0])
    mean = np.array([v / n for v in s])
    covariance = _totals(distinct, lambda x: (x - mean).T @ (x - mean), "double") / n
    e, v = components((covariance + covariance.T) / 2, min(k, dim))
    trace = float(np.trace(covariance))
    live = e > TOLERANCE * max(trace, 1e-300)
    weights = v / np.where(live, np.sqrt(np.maximum(e, 1e-300)), np.inf)

    def project(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = (matrix(batch.column("x")) - mean) @ weights
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel())], [*names, "y"])

        return run

    live_at = [i for i in range(len(e)) if live[i]]
    error = F.lit(None).cast("double")
    if live_at:
        projected = distinct.mapInArrow(project([]), "y array<double>")
        pairs = [F.covar_pop(F.col("y")[i], F.col("y")[j]).alias(f"c{i}_{j}") for i in live_at for j in live_at if i <= j]
        got = projected.agg(*pairs).first()
        error = F.lit(max(abs(got[f"c{i}_{j}"] - (i == j)) for i in live_at for j in live_at if i <= j))
    # n^2 sum(x^2) - 2 n sum(x S) + sum(S^2), in whole numbers
    exact = lambda value: F.lit(Decimal(value)).cast("decimal(38,0)")
    squares = F.aggregate("x", F.lit(0).cast("long"), lambda t, c: t + c * c).cast("decimal(19,0)")
    crossed = F.aggregate(F.zip_with("x", F.array(*[F.lit(c).cast("long") for c in s]), lambda a, b: a * b), F.lit(0).cast("long"), lambda t, c: t + c).cast("decimal(19,0)")
    deviation = (squares * exact(n * n) - crossed * exact(2 * n) + exact(sum(c * c for c in s))).cast("decimal(38,0)")
    kept = rows.withColumn("deviation", deviation).select(key, "deviation", "x")
    y = kept.mapInArrow(project([key, "deviation"]), f"`{key}` {kind.simpleString()}, deviation decimal(38,0), y array<double>")
    each = y.select(key, "deviation", F.posexplode("y").alias("i", "w"))
    share = F.array(*[F.lit(float(x) / trace if trace > 0 else None).cast("double") for x in e])
    alive = F.array(*[F.lit(bool(x)) for x in live])
    out = each.select(key, (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(alive[F.col("i")], F.col("w")).alias("whitened"), share[F.col("i")].alias("explained"), error.alias("identity_error"))
    return out.select(*out_columns)
