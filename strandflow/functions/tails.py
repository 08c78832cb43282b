"""Tails of the normal and of Student's distribution as column expressions: sums of positive terms, so small tails keep their digits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandflow.functions.sequence import let, total

#: Steps of the trapezoid sums: of the normal tail far from and near the middle, and of the tanh-sinh sum of Student's.
FAR, NEAR, ENDS = 0.25, 0.1, 1 / 64
FAR_TERMS, NEAR_TERMS, END_TERMS = 28, 380, 224


def normal_two_sided(z: Column) -> Column:
    """The chance that a standard normal value is at least as far from 0 as z; null for null.

    erfc(x) is exp(-x^2) times 2/pi times the integral of exp(-u^2) x / (x^2 + u^2) over u > 0, or with u = x sinh(s) of exp(-x^2 sinh(s)^2) / cosh(s).
    Trapezoid sums of these converge exponentially: the first from x = 1.5 on, the second below.
    """

    def of(x: Column) -> Column:
        far = total(F.transform(F.sequence(F.lit(1), F.lit(FAR_TERMS)), lambda k: F.exp(-(k * FAR) * (k * FAR)) * x / (x * x + (k * FAR) * (k * FAR))), 0.0)
        near = total(F.transform(F.sequence(F.lit(1), F.lit(NEAR_TERMS)), lambda k: F.exp(-x * x * F.sinh(k * NEAR) * F.sinh(k * NEAR)) / F.cosh(k * NEAR)), 0.0)
        return F.when(x > 28, 0.0).otherwise(F.exp(-x * x) * F.when(x >= 1.5, (2 * FAR / math.pi) * (0.5 / F.nullif(x, F.lit(0.0)) + far)).otherwise((2 * NEAR / math.pi) * (0.5 + near)))  # beyond 28 it is less than the least double

    return F.when(z.isNotNull(), F.least(let(F.abs(z.cast("double")) / math.sqrt(2), of), F.lit(1.0)))


def normal_greater(z: Column) -> Column:
    """The chance that a standard normal value is z or more."""
    return F.when(z >= 0, normal_two_sided(z) / 2).otherwise(1 - normal_two_sided(z) / 2)


def student_two_sided(t: Column, freedom: Column) -> Column:
    """The chance that a value of Student's distribution is at least as far from 0 as t; null for null and for no degrees of freedom.

    The share of the integral of sin(a)^(freedom - 1) up to pi/2 that lies below atan(sqrt(freedom) / |t|), both by tanh-sinh sums.
    """

    def below(end: Column, power: Column) -> Column:
        def term(j: Column) -> Column:
            u = F.sinh(j * ENDS) * math.pi
            share = 1 / (1 + F.exp(-u))
            return F.coalesce(F.exp(power * F.log(F.sin(end * share))), F.lit(0.0)) * F.cosh(j * ENDS) * share / (1 + F.exp(u))

        return end * total(F.transform(F.sequence(F.lit(-END_TERMS), F.lit(END_TERMS)), term), 0.0)

    power = freedom.cast("double") - 1
    angle = F.atan2(F.sqrt(freedom.cast("double")), F.abs(t.cast("double")))
    value = let(angle, lambda a: below(a, power)) / below(F.lit(math.pi / 2), power)
    return F.when(t.isNotNull() & (freedom >= 1), F.least(value, F.lit(1.0)))


def correlation_t(r: Column, n: Column) -> Column:
    """Student's t of a correlation over n rows; null for fewer than three, infinite for a perfect one."""
    rest = F.greatest(1 - r * r, F.lit(0.0))
    return F.when(n >= 3, F.when(rest == 0, F.lit(math.inf) * F.sign(r)).otherwise(r * F.sqrt((n - 2) / F.nullif(rest, F.lit(0.0)))))
