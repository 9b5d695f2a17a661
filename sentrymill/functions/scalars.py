"""Scalar builders shared by operators; all are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(value: Column, threshold: float, scale: float) -> Column:
    """Ramp from 0 at threshold to 1 at threshold + scale."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - threshold) / scale))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def round_hit(amount: Column, targets: tuple = (100, 500, 1000, 5000)) -> Column:
    return reduce(lambda a, b: a | b, [F.abs(amount - float(t)) < 0.005 for t in targets])


def crc_bucket(text: Column, k: int) -> Column:
    return F.crc32(text.cast("binary")) % k


def fold_of(key: Column, shares: dict[str, float]) -> Column:
    """Fold by the first 15 hex digits of SHA-256 of the key as a share of one, over cumulated shares."""
    u = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 15), 16, 10).cast("double") / float(16**15)
    out, total = F.lit(None).cast("string"), sum(shares.values())
    edge = 1.0
    for name, share in reversed(list(shares.items())):
        out = F.when(u < edge, F.lit(name)).otherwise(out)
        edge -= share / total
    return out


def exposure(declared: Column, ratio: Column) -> Column:
    """Declared volume times the realised ratio where that is a positive number."""
    return F.when(ratio.isNotNull() & ~F.isnan(ratio) & (ratio > 0) & (ratio < float("inf")), declared * ratio).otherwise(declared)


def shrunk(mean: Column, n: Column, prior: Column, weight: float = 30.0) -> Column:
    """(n x + weight prior) / (n + weight)."""
    return (n * mean + weight * prior) / (n + weight)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, d = hits / n, 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (centre - half) / d), F.least(F.lit(1.0), (centre + half) / d)
