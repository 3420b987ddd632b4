"""Scalings of numeric columns. NaN and infinities count as missing and stay missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many values the built-in exact percentile is used; beyond, the ranks are bracketed first.
EXACT_VALUES = 1_000_000
#: Share of the ranks on either side of a bracketed quantile.
BRACKET = 1e-3


def finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def quantiles(df: DataFrame, column: Column, shares: list[float]) -> list[float | None]:
    """Exact linear-interpolated quantiles; missing values are left out.

    Beyond EXACT_VALUES the values are not held in one buffer: approximate quantiles bracket each
    rank, and the bracket is narrowed by aggregates until it holds so few. Only scalars come to the driver.
    """
    values = df.select(finite(column).alias("v")).where("v IS NOT NULL")
    edges = [min(1.0, max(0.0, s + d)) for s in shares for d in (-BRACKET, BRACKET)]
    first = values.agg(F.count("v").alias("n"), F.percentile_approx("v", edges, 10_000).alias("at")).first()
    n = first["n"]
    if not n:
        return [None] * len(shares)
    if n <= EXACT_VALUES:
        return list(values.agg(F.percentile("v", [float(s) for s in shares]).alias("q")).first()["q"])
    return [_at_rank(values, share * (n - 1), n, *first["at"][2 * k : 2 * k + 2]) for k, share in enumerate(shares)]


def _at_rank(values: DataFrame, rank: float, n: int, lo: float, hi: float) -> float:
    """The value at a rank between 0 and n - 1, between neighbours by share, given values around it."""
    low, high, v = int(rank), min(int(rank) + 1, n - 1), F.col("v")
    while True:
        inner = v.between(lo, hi)
        got = values.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in (("below", v < lo), ("inside", inner), ("at_lo", v == lo), ("at_hi", v == hi))], F.min(v).alias("least"), F.max(v).alias("most")).first()
        below, inside = got["below"], got["inside"]
        if below > low or high >= below + inside:  # the bracket missed the rank
            lo, hi = (got["least"] if below > low else lo), (got["most"] if high >= below + inside else hi)
            continue
        ends = [lo if k < below + got["at_lo"] else hi if k >= below + inside - got["at_hi"] else None for k in (low, high)]
        if None not in ends:
            return ends[0] + (ends[1] - ends[0]) * (rank - low)
        held = values.where(inner)
        if inside <= EXACT_VALUES:
            return held.agg(F.percentile(v, float((rank - below) / (inside - 1)))).first()[0]
        shares = [max(0.0, (low - below) / inside - BRACKET), min(1.0, (high - below) / inside + BRACKET)]
        new = tuple(held.agg(F.percentile_approx(v, shares, 10_000)).first()[0])
        if new == (lo, hi):  # many equal values at both ends
            between = held.where((v > lo) & (v < hi)).agg(F.min(v), F.max(v)).first()
            new = (lo if ends[0] is not None else between[0], hi if ends[1] is not None else between[1])
            if new == (lo, hi):
                return held.agg(F.percentile(v, float((rank - below) / (inside - 1)))).first()[0]
        lo, hi = new


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def _between(c: Column, lo: float | None, hi: float | None) -> Column:
    if lo is None or hi is None:
        return F.lit(0.0)
    if abs(lo - hi) <= 1e-8 + 1e-5 * abs(hi):
        return F.when(c.isNotNull(), F.lit(0.5))
    return (c - lo) / (hi - lo)


def minmax_01(df: DataFrame, column: Column) -> Column:
    """Scaled to [0, 1] by the least and greatest; one half where all are equal, 0 where none is finite."""
    v = finite(column)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    return _between(v, lo, hi)


def robust_01(df: DataFrame, column: Column, low: float = 0.03, high: float = 0.97) -> Column:
    """Scaled by two quantiles and clipped; by the range where the quantiles are equal."""
    v = finite(column)
    lo, hi = quantiles(df, column, [low, high])
    if lo is not None and abs(lo - hi) <= 1e-8 + 1e-5 * abs(hi):
        return minmax_01(df, column)
    return clip01(_between(v, lo, hi)) if lo is not None else F.lit(0.0)


def rooted(column: Column, kind: str) -> Column:
    v = F.greatest(finite(column), F.lit(0.0))
    v = F.when(finite(column).isNotNull(), v)
    return {"sqrt": F.sqrt(v), "cbrt": F.cbrt(v)}.get(kind, v)


def proximity(df: DataFrame, distance: Column, kind: str, share: float) -> Column:
    """exp(-root/scale), the scale being a quantile of the roots; their mean, 1 at least, where that is 0."""
    t = rooted(distance, kind)
    scale = quantiles(df, t, [share])[0]
    if not scale or scale <= 0:
        scale = max(df.agg(F.avg(t)).first()[0] or 0.0, 1.0)
    return clip01(F.exp(-t / scale))


def classes(score: Column, n: int = 20) -> Column:
    """Equal classes of [0, 1] from 0 to n - 1; missing scores are class 0."""
    return F.coalesce(F.least(F.floor(score * n), F.lit(n - 1)), F.lit(0)).cast("int")


def standardised(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Each column less its mean by its deviation over all rows; one that doesn't vary is 0. Missing values stay missing."""
    got = df.agg(*[f(finite(F.col(c))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (finite(F.col(c)) - got[f"m{i}"]) / (got[f"s{i}"] or 1.0) if got[f"m{i}"] is not None else finite(F.col(c)) for i, c in enumerate(columns)}
