"""Number handling: clipping, rounding, rule input values, normal tails."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

INF_RATIO = 999999.0


def no_nan(value: Column) -> Column:
    """NaN stored as null."""
    return F.when(~F.isnan(value), value)


def clip_above(value: Column, cap: Column) -> Column:
    """Null stays null, unlike a bare ``least``."""
    return F.when(value.isNotNull(), F.least(value, cap))


def clip_below(value: Column, base: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, base))


def ratio(num: Column, den: Column) -> Column:
    """num / den; ±inf is carried as ±999999 and 0/0 as null."""
    return (F.when(den != 0, num / den)
            .when(num > 0, F.lit(INF_RATIO))
            .when(num < 0, F.lit(-INF_RATIO)))


def rule_value(value: Column) -> Column:
    """What a rule compares: missing or NaN is 0, infinite is 999999."""
    return (F.when(value.isNull() | F.isnan(value), F.lit(0.0))
            .when(F.abs(value) == float("inf"), F.lit(INF_RATIO))
            .otherwise(value))


def round_digits(value: Column, digits: int) -> Column:
    """-1 leaves the value as it is."""
    return value if digits == -1 else F.round(value, digits)


def significant(value: Column, digits: int = 6) -> Column:
    """Rounded to significant digits, the numeric text form of the exports."""
    exponent = F.floor(F.log10(F.abs(value)))
    factor = F.pow(F.lit(10.0), F.lit(digits - 1) - exponent)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.rint(value * factor) / factor)


def kelvin_to_celsius(value: Column) -> Column:
    return value - 273.15


def probit(p: float) -> float:
    """z with P(Z <= z) = p; a driver-side constant."""
    return NormalDist().inv_cdf(p)


def exceeds_with(mean: Column, sd: Column, threshold: Column, p: float) -> Column:
    """P(N(mean, sd) > threshold) > p, decided without computing the tail.

    Standardising turns the test into one comparison against a constant, so
    no rounding of the probability can flip a decision.
    """
    z = (mean - threshold) / sd
    return F.when(sd > 0, z > probit(p))


def upper_tail(mean: Column, sd: Column, threshold: Column) -> Column:
    """P(N(mean, sd) > threshold), absolute error below 1e-12.

    Spark has no erf. Series around the centre (|z| < 3.5) and a continued
    fraction in the tails, both fixed-length, so the value is one expression
    inside generated code.
    """
    z = (mean - threshold) / sd
    return F.when(sd > 0, normal_cdf(z))


def normal_cdf(z: Column) -> Column:
    x = F.abs(z)
    density = F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
    # centre: Phi(x) = 1/2 + phi(x) * sum x^(2k+1) / (1*3*...*(2k+1))
    steps = F.sequence(F.lit(1), F.lit(60))
    series = F.aggregate(
        steps, F.struct(x.alias("term"), x.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * x * x / (2.0 * k + 1.0)).alias("term"),
            (acc["total"] + acc["term"] * x * x / (2.0 * k + 1.0)).alias("total")),
        lambda acc: acc["total"])
    # tail: Q(x) = phi(x) / (x + 1/(x + 2/(x + 3/(x + ...))))
    fraction = F.aggregate(
        F.sequence(F.lit(40), F.lit(1), F.lit(-1)), x,
        lambda acc, k: x + k / acc)
    tail = F.when(x < 3.5, 0.5 - density * series).otherwise(density / fraction)
    return F.when(z < 0, tail).otherwise(1.0 - tail)
