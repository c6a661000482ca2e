"""Numbers derived from hashes of (seed, keys): independent of partitioning and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex32(seed: int, *keys) -> Column:
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])), 1, 8)


def uniform(seed: int, *keys) -> Column:
    """Uniform in [0, 1): the first 32 bits of the digest."""
    return F.conv(_hex32(seed, *keys), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, *keys) -> Column:
    """Standard normal by Box-Muller from two uniforms."""
    u = F.greatest(uniform(seed, *keys, "a"), F.lit(2.0**-33))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * uniform(seed, *keys, "b"))


def ternary(seed: int, density: float, *keys) -> Column:
    """-1, 0 or 1 with probability density/2, 1 - density, density/2."""
    u = uniform(seed, *keys)
    return F.when(u < density / 2, -1.0).when(u >= 1 - density / 2, 1.0).otherwise(0.0)


def order_key(seed: int, *keys) -> Column:
    """A string to shuffle rows by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]))
