"""Special functions as column expressions: the tails of the normal, Student t and
chi-square distributions, by the regularised incomplete beta and gamma functions.

Series and continued fractions run as ``aggregate`` over a sequence of steps; the number
of steps grows with the root of the degrees of freedom, as their convergence does.  Null
arguments and degrees of freedom that are not positive give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series for the logarithm of gamma, in 1/y, 1/y^3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 8  # the series is taken at the argument plus SHIFT, where its rest is below 1e-12
TINY = 1e-300
#: Above these degrees of freedom Student's tail is taken by Hill's normal deviate (rest below
#: 1e-12), as the fraction's steps grow with their root.
LARGE_DOF = 1e4


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of named values, each computed once."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(k) for k, v in values.items()])), body)[0]


def _rest(y: Column) -> Column:
    """What Stirling's series adds to (y - 1/2) ln y - y + ln(2 pi) / 2."""
    inverse, total = 1 / y, F.lit(0.0)
    for c in reversed(STIRLING):
        total = total * inverse * inverse + F.lit(c)
    return total * inverse


def log_gamma(a: Column) -> Column:
    """Logarithm of gamma of a positive number."""
    y = a + F.lit(float(SHIFT))
    steps = sum((F.log(a + F.lit(float(k))) for k in range(SHIFT)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + F.lit(math.log(2 * math.pi) / 2) + _rest(y) - steps


def log_gamma_ratio(a: Column, b: Column) -> Column:
    """log_gamma(a + b) - log_gamma(a), without the cancellation of the two at large ``a``."""
    y = a + F.lit(float(SHIFT))
    steps = sum((F.log1p(b / (a + F.lit(float(k)))) for k in range(SHIFT)), F.lit(0.0))
    return (y - 0.5) * F.log1p(b / y) + b * F.log(y + b) - b + _rest(y + b) - _rest(y) - steps


def _steps(size: Column, least: int) -> Column:
    return F.sequence(F.lit(1), (F.lit(least) + F.ceil(F.sqrt(size) * 12)).cast("int"))


def _not_zero(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(steps: Column, top: Callable[[Column], Column], bottom: Callable[[Column], Column], first: Column) -> Column:
    """first + top(1) / (bottom(1) + top(2) / (bottom(2) + ...)), from the top down."""

    def step(s: Column, j: Column) -> Column:
        j = j.cast("double")
        c, d = _not_zero(bottom(j) + top(j) / s["c"]), 1 / _not_zero(bottom(j) + top(j) * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    start = F.struct(first.cast("double").alias("c"), F.lit(0.0).alias("d"), first.cast("double").alias("h"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function."""

    def top(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j == 2 * m, even).otherwise(odd)

    return 1 / _fraction(_steps(F.greatest(a, b), 200), top, lambda j: F.lit(1.0), F.lit(1.0))


def student_t_two_sided(t: Column, dof: Column) -> Column:
    """Probability that a Student t variable is further from 0 than ``t``."""

    def tail(v: Column) -> Column:
        a, b = v["dof"] / 2, F.lit(0.5)
        total = v["dof"] + v["t"] * v["t"]
        low, high = v["dof"] / total, v["t"] * v["t"] / total  # x and 1 - x, each without cancellation
        front = F.exp(log_gamma_ratio(a, b) - math.log(math.pi) / 2 - a * F.log1p(v["t"] * v["t"] / v["dof"]) + b * F.log(high))
        near = low < (a + 1) / (a + b + 2)  # there the fraction converges; elsewhere the mirrored one does
        part = _let(
            lambda w: w["front"] * _beta_fraction(w["a"], w["b"], w["x"]) / w["a"],
            front=front, a=F.when(near, a).otherwise(b), b=F.when(near, b).otherwise(a), x=F.when(near, low).otherwise(high),
        )
        return F.when(high <= 0, F.lit(1.0)).when(near, part).otherwise(1 - part)

    def deviate(v: Column) -> Column:
        a = v["dof"] - 0.5
        z = F.sqrt(a * F.log1p(v["t"] * v["t"] / v["dof"]))
        return z + (z * z * z + 3 * z) / (48 * a * a)

    small = F.when(dof <= LARGE_DOF, _let(tail, t=t, dof=dof)).otherwise(normal_two_sided(_let(deviate, t=t, dof=dof)))
    return F.when((dof > 0) & t.isNotNull(), small)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x)."""

    def tail(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(a * F.log(x) - x - log_gamma(a))

        def term(s: Column, j: Column) -> Column:
            t = s["t"] * x / (a + j)
            return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

        series = F.aggregate(_steps(a, 100), F.struct((1 / a).alias("t"), (1 / a).alias("s")), term, lambda s: s["s"])
        fraction = 1 / _fraction(_steps(a, 200), lambda j: -j * (j - a), lambda j: x + 2 * j + 1 - a, x + 1 - a)
        return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return F.when((a > 0) & x.isNotNull(), _let(tail, a=a, x=x))


def normal_two_sided(z: Column) -> Column:
    """Probability that a standard normal variable is further from 0 than ``z``."""
    return upper_gamma(F.lit(0.5), z * z / 2)


def chi_square_upper(x: Column, dof: Column) -> Column:
    """Probability that a chi-square variable of ``dof`` degrees of freedom is above ``x``."""
    return upper_gamma(dof / 2, x / 2)
