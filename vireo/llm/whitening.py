"""Whitening of embeddings by a one-sided Jacobi SVD of their TSQR factor.

Rows are centred before anything is multiplied, and no Gram matrix is formed:
each task folds its centred rows block by block into a triangular factor R (at
most d x d), factors meet ``FAN_IN`` at a time until one is left, and plane
rotations make its columns orthogonal on the driver, which holds d x d numbers
whatever the table. Column lengths over sqrt(n) are the standard deviations, the
accumulated rotations the components.

Defined results: a vector counts if it is not null, has as many entries as most
vectors have (ties: the greater number; empty ones never), and all entries are
finite and below 2^37 in size; all others are dropped. Repeated rows count each
time. A direction without spread (a standard deviation under 1e-12 of the
greatest) whitens to 0 and is left out of ``identity_error``. No vectors left: a
table without rows. Other columns stay; an added column whose name is taken
gets a numbered one (``Whitening.names`` has them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vireo.llm.common import cut, free_name, map_arrow, map_partitions_arrow, ship

#: Fixed values of the grid on which entries lie.
SCALE, SHIFT = 1024.0, 100000
#: Entries of this size or more don't count as finite: sums of a record batch stay below 2^63.
LARGEST = 2.0**37
FAN_IN = 16
#: Below this share of the greatest standard deviation a direction has no spread.
FLAT = 1e-12
SWEEPS = 60
BLOCK_ROWS = 4096


def grid(vectors: pa.Array, d: int) -> np.ndarray:
    """n x d whole numbers floor(1024 c) + 100000, in double arithmetic."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, d) + SHIFT


def usable(vec: str, d: int | None = None):
    """Whether a vector counts, for its entries and (if given) its length."""
    fine = F.col(vec).isNotNull() & F.forall(vec, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    return F.coalesce(fine & ((F.size(vec) > 0) if d is None else (F.size(vec) == d)), F.lit(False))


def sums(rows: DataFrame, vec: str, d: int) -> tuple[int, list[int]]:
    """(n, exact sum of each entry on the grid)."""

    def fold(batches):
        n, total = 0, [0] * d
        for b in batches:
            if b.num_rows:
                n += b.num_rows
                total = [t + int(s) for t, s in zip(total, grid(b.column(0), d).sum(axis=0), strict=True)]
        if n:
            yield {"j": list(range(-1, d)), "value": [str(n), *map(str, total)]}

    parts = map_partitions_arrow(rows.select(vec), fold, "j int, value string")
    got = {r[0]: int(r[1]) for r in parts.groupBy("j").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect()}
    return got.get(-1, 0), [got.get(j, 0) for j in range(d)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n, where the whole part of S/n is taken off before rounding can matter."""
    whole = np.array([s // n for s in total], dtype=np.int64)
    return (x - whole).astype(np.float64) - np.array([(s % n) / n for s in total])


def _triangle(stack: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(stack), mode="r")


def triangular_factor(rows: DataFrame, vec: str, d: int, n: int, total: list[int]) -> np.ndarray:
    """R (at most d x d) with R'R = Y'Y for the centred rows Y."""

    def fold(batches):
        r = np.zeros((0, d))
        for b in batches:
            y = centred(grid(b.column(0), d), n, total) if b.num_rows else np.zeros((0, d))
            for k in range(0, len(y), BLOCK_ROWS):
                r = _triangle([r, y[k : k + BLOCK_ROWS]])
        if len(r):
            yield {"block": [TaskContext.get().partitionId()] * len(r), "i": list(range(len(r))), "row": list(r)}

    schema = "block long, i int, row array<double>"
    level = cut(map_partitions_arrow(rows.select(vec), fold, schema))
    most = level.agg(F.max("block")).first()[0] or 0
    target = pa.schema([("block", pa.int64()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def meet(key, table):
        # The factors in order of block and row: sums in another order would round otherwise.
        table = table.sort_by([("block", "ascending"), ("i", "ascending")])
        r = _triangle([np.array(table.column("row").combine_chunks().flatten()).reshape(-1, d)])
        return pa.Table.from_pydict({"block": [key[0].as_py()] * len(r), "i": list(range(len(r))), "row": list(r)}, schema=target)

    while most > 0:
        level = level.groupBy(F.floor(F.col("block") / FAN_IN).cast("long").alias("to")).applyInArrow(meet, schema)
        most //= FAN_IN
    return np.array([r["row"] for r in sorted(level.collect(), key=lambda r: r["i"])]).reshape(-1, d)


def one_sided_jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the orthogonalised columns, descending; the rotations' columns to match).

    A sweep meets every pair of columns once, in rounds of disjoint pairs that
    are rotated together; it ends when no pair's cosine exceeds a few units of
    rounding.
    """
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    order = list(range(d + d % 2))  # a round robin; with an odd number one column rests
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(order) - 1):
            half = len(order) // 2
            pairs = [(min(p), max(p)) for p in zip(order[:half], order[half:][::-1], strict=True) if max(p) < d]
            if pairs:
                i, j = np.array(pairs).T
                x, y = a[:, i], a[:, j]
                alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
                size = np.sqrt(alpha) * np.sqrt(beta)
                cosine = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
                turn = cosine > 1e-15
                worst = max(worst, float(cosine.max()))
                zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
                s = np.where(turn, t * c, 0.0)
                for m in (a, v):
                    p, q = m[:, i].copy(), m[:, j].copy()
                    m[:, i], m[:, j] = c * p - s * q, s * p + c * q
            order = [order[0], order[-1], *order[1:-1]]
        if worst <= 1e-14:
            break
    length = np.sqrt((a * a).sum(0)) if len(a) else np.zeros(d)
    down = np.argsort(-length, kind="stable")
    return length[down], v[:, down]


@dataclass
class Whitening:
    """What was fitted: n vectors, their exact sums, d components (columns) and standard deviations."""

    n: int
    total: list[int]
    components: np.ndarray
    deviations: np.ndarray
    taken: int
    identity_error: float = 0.0

    @property
    def d(self) -> int:
        return len(self.total)

    @property
    def explained(self) -> np.ndarray:
        """Share of each component's variance in that of all."""
        e = self.deviations**2
        return e / e.sum() if e.sum() > 0 else np.zeros(len(e))

    def scales(self) -> np.ndarray:
        """1 / standard deviation of the components taken, 0 for those without spread."""
        s = self.deviations[: self.taken]
        fine = s > FLAT * max(self.deviations.max(initial=0.0), 0.0)
        return np.divide(1.0, s, out=np.zeros_like(s), where=fine & (s > 0))

    def project(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.n, self.total) @ self.components[:, : self.taken]) * self.scales()

    def squared_deviation(self, x: np.ndarray) -> list[int]:
        """Exact sum over entries of (n x - S)^2, in 64 bits where that is proven to do."""
        reach = float(np.abs(centred(x, self.n, self.total)).max(initial=0.0)) * self.n + self.n
        if self.d * reach * reach < 2.0**62 and self.n * (float(np.abs(x).max(initial=0)) + 1) < 2.0**62:
            off = self.n * x - np.array(self.total, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        return [sum((self.n * e - s) ** 2 for e, s in zip(row, self.total, strict=True)) for row in x.tolist()]


def fit(vectors: DataFrame, vec: str = "embedding", components: int = 8) -> Whitening | None:
    """Fits to all vectors that count; None if there are none. ``identity_error`` comes from a pass over all of them."""
    widths = vectors.where(usable(vec)).groupBy(F.size(vec).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    width = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if width is None:
        return None
    d = width["width"]
    rows = vectors.where(usable(vec, d))
    n, total = sums(rows, vec, d)
    length, turn = one_sided_jacobi(triangular_factor(rows, vec, d, n, total))
    lead = turn[np.abs(turn).argmax(axis=0), np.arange(d)]
    model = Whitening(n, total, turn * np.where(lead < 0, -1.0, 1.0), length / np.sqrt(n), min(components, d))
    spread = model.scales() > 0
    cov = covariance(rows, vec, model)[np.ix_(spread, spread)]
    model.identity_error = float(np.abs(cov - np.eye(len(cov))).max(initial=0.0))
    return model


def covariance(rows: DataFrame, vec: str, model: Whitening) -> np.ndarray:
    """Covariance (divisor n) of the whitened rows: each task's mean and centred products, merged in order of task."""

    def merge(a, b):
        if a is None:
            return b
        n, off = a[0] + b[0], b[1] - a[1]
        return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)

    def fold(batches):
        have = None
        for b in batches:
            if b.num_rows:
                w = model.project(grid(b.column(0), model.d))
                mean = w.mean(axis=0)
                have = merge(have, (len(w), mean, (w - mean).T @ (w - mean)))
        if have:
            yield {"block": [TaskContext.get().partitionId()], "n": [have[0]], "mean": [have[1]], "products": [have[2].ravel()]}

    k = model.taken
    schema = "block long, n long, mean array<double>, products array<double>"
    target = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])
    level = cut(map_partitions_arrow(rows.select(vec), fold, schema))
    most = level.agg(F.max("block")).first()[0] or 0

    def meet(key, table):
        have = None
        for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
            have = merge(have, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
        return pa.Table.from_pydict({"block": [key[0].as_py()], "n": [have[0]], "mean": [have[1]], "products": [have[2].ravel()]}, schema=target)

    while most > 0:
        level = level.groupBy(F.floor(F.col("block") / FAN_IN).cast("long").alias("to")).applyInArrow(meet, schema)
        most //= FAN_IN
    got = level.first()
    return np.array(got["products"]).reshape(k, k) / got["n"]


def whiten(vectors: DataFrame, vec: str = "embedding", components: int = 8, model: Whitening | None = None) -> DataFrame:
    """Rows that count, with ``whitened`` (array of the first components) and ``deviation``.

    ``deviation``, the sum over entries of (n x - S)^2, is exact; null where it doesn't fit 64 bits.
    """
    model = model or fit(vectors, vec, components)
    names = [free_name(vectors, "whitened"), free_name(vectors, "deviation")]
    schema = T.StructType([*vectors.schema.fields, T.StructField(names[0], T.ArrayType(T.DoubleType())), T.StructField(names[1], T.LongType())])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    ship(vectors.sparkSession)

    def run(batch):
        x = grid(batch.column(vec), model.d)
        deviation = [v if v < 2**63 else None for v in model.squared_deviation(x)]
        return dict(zip(batch.schema.names, batch.columns, strict=True)) | {names[0]: list(model.project(x)), names[1]: deviation}

    return map_arrow(vectors.where(usable(vec, model.d)), run, schema)


def components_table(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(component from 1, explained, standard_deviation, direction) of the components taken."""
    rows = [(k + 1, float(model.explained[k]), float(model.deviations[k]), model.components[:, k].tolist()) for k in range(model.taken)]
    return vectors.sparkSession.createDataFrame(rows, "component int, explained double, standard_deviation double, direction array<double>")
