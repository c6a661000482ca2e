"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row.

    What a lambda captures is computed again for each element, so every norm or
    dot product that a lambda uses is bound by this first.
    """
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scale(a: Column, k) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return let(k, lambda c: F.transform(a, lambda x: x * c))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _by_norm(a: Column, factor) -> Column:
    """a times ``factor(norm)``."""
    return let(a, lambda v: scale(v, factor(norm(v))))


def l2_normalize(a: Column) -> Column:
    """x / max(|x|, 1e-12)."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(TINY)), lambda n: F.transform(v, lambda x: x / n)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def softmax(a: Column) -> Column:
    shifted = let(a, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    total = lambda e: F.greatest(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), F.lit(TINY))
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def exp0(a: Column) -> Column:
    """Exponential map at the origin of the Poincare ball: tanh(|x|) x / |x|."""
    return _by_norm(a, lambda n: F.tanh(F.greatest(n, F.lit(TINY))) / F.greatest(n, F.lit(TINY)))


def _inside(n: Column) -> Column:
    return F.least(F.greatest(n, F.lit(TINY)), F.lit(1 - 1e-6))


def log0(a: Column) -> Column:
    """Logarithmic map at the origin; the norm is clipped to [1e-12, 1 - 1e-6] throughout."""
    return _by_norm(a, lambda n: F.atanh(_inside(n)) / _inside(n))


def clip_radius(a: Column, most: float = 1 - 1e-5) -> Column:
    return _by_norm(a, lambda n: F.when(n > most, most / n).otherwise(1.0))


def mobius_add(a: Column, b: Column) -> Column:
    """Moebius addition, denominator at least 1e-12, radius clipped."""

    def body(p: Column) -> Column:
        x, y = p["x"], p["y"]
        dots = F.struct(dot(x, y).alias("xy"), dot(x, x).alias("xx"), dot(y, y).alias("yy"))

        def combined(d: Column) -> Column:
            den = F.greatest(1.0 + 2.0 * d["xy"] + d["xx"] * d["yy"], F.lit(TINY))
            k = F.struct(((1.0 + 2.0 * d["xy"] + d["yy"]) / den).alias("left"), ((1.0 - d["xx"]) / den).alias("right"))
            return let(k, lambda f: F.zip_with(x, y, lambda u, v: f["left"] * u + f["right"] * v))

        return let(dots, combined)

    return clip_radius(let(F.struct(a.alias("x"), b.alias("y")), body))


def mobius_scale(w: Column, a: Column) -> Column:
    """Moebius scalar product tanh(w atanh(|x|)) x / |x|, radius clipped."""
    return clip_radius(_by_norm(a, lambda n: F.tanh(w * F.atanh(_inside(n))) / _inside(n)))


def fuse(gate: Column, structure: Column, attributes: Column) -> Column:
    """Gated hyperbolic fusion: rownorm(log0(g * exp0(s) + (1 - g) * exp0(x)))."""
    return l2_normalize(log0(mobius_add(mobius_scale(gate, exp0(structure)), mobius_scale(1.0 - gate, exp0(attributes)))))


def argmax(a: Column) -> Column:
    """Zero-based place of the first greatest value."""
    return F.array_position(a, F.array_max(a)) - 1


def all_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def unpack(df: DataFrame, vec: str, d: int, stem: str = "y") -> DataFrame:
    """Array column to ``d`` scalar columns: sums of scalars run in generated code."""
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, *[F.col(vec)[j].alias(f"{stem}{j}") for j in range(d)])


def pack(df: DataFrame, d: int, vec: str = "vec", stem: str = "y") -> DataFrame:
    cols = {f"{stem}{j}" for j in range(d)}
    return df.select(*[c for c in df.columns if c not in cols], F.array(*[f"{stem}{j}" for j in range(d)]).alias(vec))


def standard_stats(df: DataFrame, vec: str = "vec", d: int | None = None) -> tuple[list[float], list[float]]:
    """(means, population standard deviations) by position, to freeze and reuse."""
    if d is None:
        d = df.select(F.max(F.size(vec))).first()[0] or 0
    if not d:
        return [], []
    row = df.agg(*[F.avg(F.col(vec)[j]) for j in range(d)], *[F.stddev_pop(F.col(vec)[j]) for j in range(d)]).first()
    return [float(x or 0.0) for x in row[:d]], [float(x or 0.0) for x in row[d:]]


def standardize(a: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / max(std, 1e-12) with given statistics."""
    m, s = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (mean, [max(x, TINY) for x in std]))
    return F.zip_with(F.zip_with(a, m, lambda x, y: x - y), s, lambda x, y: x / y)
