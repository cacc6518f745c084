"""Vectors in array columns and tail probabilities, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigauge.functions.text import let


def round6(value: Column) -> Column:
    """Six places, with no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 when either is a zero vector."""
    return cosine_from(dot(a, b), dot(a, a), dot(b, b))


def cosine_from(ab: Column, aa: Column, bb: Column) -> Column:
    return F.when((aa <= 0) | (bb <= 0), F.lit(0.0)).otherwise(ab / F.sqrt(aa * bb))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: the all-positive series of erf below 2, and the
    continued fraction of the tail above, which keeps its digits however small the value."""

    def both(v: Column) -> Column:
        init = F.struct(v.alias("term"), v.alias("acc"))
        total = F.aggregate(
            F.sequence(F.lit(1), F.lit(40)),
            init,
            lambda s, i: let(
                s["term"] * v * v * F.lit(2.0) / (i * 2 + 1),
                lambda t: F.struct(t.alias("term"), (s["acc"] + t).alias("acc")),
            ),
            lambda s: s["acc"],
        )
        bell = F.exp(-v * v)
        near = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * bell * total
        # v + (1/2) / (v + (2/2) / (v + (3/2) / ...)), from the inside
        below = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), v, lambda s, i: v + (i / 2.0) / s)
        return F.when(v < 2.0, near).otherwise(bell / (F.lit(math.sqrt(math.pi)) * below))

    return let(x.cast("double"), both)


# Above this many degrees of freedom the finite series gives way to the normal form,
# whose error is then below the seventh place.
SERIES_MAX_DF = 1000


def correlation_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation over n pairs: Student t with n - 2 degrees of freedom.

    Abramowitz & Stegun 26.7.3 and 26.7.4, where the sine of their angle is |rho|; for many
    degrees of freedom 26.7.8. Null below three pairs.
    """
    df = (n - 2).cast("int")
    r = F.least(F.abs(rho), F.lit(1.0))
    c2 = F.lit(1.0) - r * r
    odd = (df % 2) == 1

    # terms: 1, c2 * 1/2 (or 2/3), c2^2 * 1/2 * 3/4 (or 2/3 * 4/5), ...
    def step(s: Column, i: Column) -> Column:
        ratio = F.when(odd, (i * 2) / (i * 2 + 1)).otherwise((i * 2 - 1) / (i * 2))
        return let(
            s["term"] * c2 * ratio,
            lambda t: F.struct(t.alias("term"), (s["acc"] + t).alias("acc")),
        )

    last = F.when(odd, (df - 3) / 2).otherwise(df / 2 - 1).cast("int")
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("acc"))
    summed = F.aggregate(
        F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
        one,
        step,
        lambda s: s["acc"],
    )
    inside = F.when(
        odd,
        F.lit(2.0 / math.pi)
        * (F.asin(r) + F.when(df == 1, F.lit(0.0)).otherwise(r * F.sqrt(c2) * summed)),
    ).otherwise(r * summed)
    t = r * F.sqrt(df / c2)
    normal = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return (
        F.when((df < 1) | rho.isNull(), F.lit(None).cast("double"))
        .when(r >= 1.0, F.lit(0.0))
        .when(df <= SERIES_MAX_DF, F.greatest(F.lit(0.0), F.lit(1.0) - inside))
        .otherwise(erfc(normal / math.sqrt(2.0)))
    )


def _half_gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the asymptotic series ten places up, and the recurrence back down."""
    high = a + 10.0
    back = F.lit(1.0)
    for i in range(10):
        back = back * (a + float(i)) / (a + (i + 0.5))
    series = F.lit(-1 / 8) / high + F.lit(1 / 192) / F.pow(high, 3) - F.lit(1 / 640) / F.pow(high, 5)
    return F.sqrt(high) * F.exp(series + F.lit(17 / 14336) / F.pow(high, 7)) * back


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function (Abramowitz & Stegun 26.5.8) by Lentz's method."""
    first = F.lit(1.0) / (F.lit(1.0) - (a + b) * x / (a + 1.0))

    def turn(s: Column, coefficient: Column) -> Column:
        d = F.lit(1.0) / (F.lit(1.0) + coefficient * s["d"])
        c = F.lit(1.0) + coefficient / s["c"]
        return let(
            F.struct(d.alias("d"), c.alias("c")),
            lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (s["h"] * v["c"] * v["d"]).alias("h")),
        )

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + m * 2 - 1.0) * (a + m * 2))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2) * (a + m * 2 + 1.0))
        return let(turn(s, even), lambda t: turn(t, odd))

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["h"])


def exact_correlation_p_value(rho: Column, n: Column) -> Column:
    """The same p without a switch by size.

    It is the incomplete beta function I(1 - rho^2; df / 2, 1 / 2), by its continued fraction on the side
    where it converges at once; the number of steps follows the root of n. Null below three pairs.
    """

    def value(v: Column) -> Column:
        r, df = v["r"], v["df"]
        a, b = df / 2.0, F.lit(0.5)
        r2 = r * r
        steps = (F.lit(30) + F.ceil(F.sqrt(df)) * 4).cast("int")
        front = F.exp(a * F.log1p(-r2)) * r * _half_gamma_ratio(a) / F.lit(math.sqrt(math.pi))
        tail = (F.lit(1.0) - r2) * (a + 2.5) < a + 1.0
        # one fraction, of the side that is wanted
        side = F.when(tail, F.struct(a.alias("a"), b.alias("b"), (F.lit(1.0) - r2).alias("x"))).otherwise(
            F.struct(b.alias("a"), a.alias("b"), r2.alias("x"))
        )
        part = let(side, lambda s: front * _beta_fraction(s["a"], s["b"], s["x"], steps) / s["a"])
        return let(part, lambda p: F.when(tail, p).otherwise(F.lit(1.0) - p))

    r = F.least(F.abs(rho), F.lit(1.0))
    df = (n - 2).cast("double")
    inner = let(F.struct(r.cast("double").alias("r"), df.alias("df")), value)
    return F.when((df < 1) | rho.isNull(), F.lit(None).cast("double")).when(r >= 1.0, F.lit(0.0)).otherwise(inner)
