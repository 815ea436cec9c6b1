"""Numeric rules shared by every operator: rounding, guarded division, ladders, p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec, functions as F


def half_up(value: Column, places: int = 2) -> Column:
    """Round with halves toward plus infinity, whatever the sign."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, or NULL unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def pct_change(current: Column, base: Column) -> Column:
    """Percent change on a positive base, 2 decimals; NULL otherwise."""
    return half_up(F.when(base > 0, (current - base) / base * 100.0))


def cagr(first: Column, last: Column, years: int) -> Column:
    ok = (first > 0) & (last > 0)
    return half_up(F.when(ok, (F.pow(last / first, F.lit(1.0 / years)) - 1.0) * 100.0))


def direction(value: Column, dead_band: float) -> Column:
    return (
        F.when(value > dead_band, F.lit("up")).when(value < -dead_band, F.lit("down")).otherwise(F.lit("flat"))
    )


def ladder(value: Column, steps: list[tuple[float, float]], top: float, unknown: float) -> Column:
    """Step function: the first ``value < bound`` wins, ``unknown`` for NULL."""
    out = F.when(value.isNull(), F.lit(unknown))
    for bound, score in steps:
        out = out.when(value < bound, F.lit(score))
    return out.otherwise(F.lit(top))


def money(cents: Column) -> Column:
    """Whole cents (exact, order-independent to sum) back to currency units."""
    return cents.cast("double") / 100.0


def cents_half_up(value: Column) -> Column:
    """Half-up rounding of an amount held in cents, returned in currency units."""
    return F.floor(value + 0.5) / F.lit(100.0)


def exact_slope(y: Column, x: Column, over: WindowSpec | None = None) -> Column:
    """OLS slope of whole-number y on whole-number x.

    The sums are exact integers, so the slope is the same for any row order; NULL y are skipped and
    fewer than two distinct x give NULL.
    """
    wrap = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    xv = F.when(y.isNotNull(), x.cast("bigint"))
    n, sx, sy = wrap(F.count(y)), wrap(F.sum(xv)), wrap(F.sum(y))
    sxy, sxx = wrap(F.sum(xv * y)), wrap(F.sum(xv * xv))
    den = n * sxx - sx * sx
    return F.when(den != 0, (n * sxy - sx * sy).cast("double") / den.cast("double"))


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom.

    Finite series in cos(theta), theta = atan(t / sqrt(df)) (Abramowitz and Stegun 26.7.3-4).
    """
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))

    def step(acc: Column, j: Column) -> Column:
        jd = j.cast("double")
        factor = F.when(odd, 2.0 * jd / (2.0 * jd + 1.0)).otherwise((2.0 * jd - 1.0) / (2.0 * jd))
        return F.struct((acc["total"] + acc["term"]).alias("total"), (acc["term"] * cos2 * factor).alias("term"))

    series = F.aggregate(
        F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0.0).alias("total"), first.alias("term")),
        step,
        lambda acc: acc["total"],
    )
    central = F.when(odd, (theta + F.sin(theta) * series) * F.lit(2.0 / math.pi)).otherwise(F.sin(theta) * series)
    return F.when(df < 1, F.lit(1.0)).otherwise(clamp(1.0 - central, 0.0, 1.0))


def fisher_p(sum_ln_p: Column, k: Column) -> Column:
    """Right tail of chi-square with 2k degrees of freedom at -2 * sum(ln p)."""
    half = -sum_ln_p
    tail = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))),
        F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term")),
        lambda acc, i: F.struct(
            (acc["total"] + acc["term"]).alias("total"), (acc["term"] * half / i.cast("double")).alias("term")
        ),
        lambda acc: acc["total"],
    )
    return F.when((half <= 0) | (k < 1), F.lit(1.0)).otherwise(clamp(F.exp(-half) * tail, 0.0, 1.0))


def percent_rank_of(rank: Column, n: Column) -> Column:
    """Share strictly below among the others; 0.5 for a batch of one."""
    return F.when(n <= 1, F.lit(0.5)).otherwise((rank - 1) / (n - 1))


def min_max(value: Column, low: Column, high: Column, flat: float) -> Column:
    return F.when(high == low, F.lit(flat)).otherwise((value - low) / (high - low))
