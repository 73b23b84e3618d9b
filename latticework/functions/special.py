"""Special functions and random variates as Spark columns: series and asymptotic forms, no Python in the tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8  #: the asymptotic series are taken at x + SHIFT, where they hold to ten digits or so


def _shifted(x: Column, at: Column, series: Sequence[tuple[float, int]], step) -> Column:
    """Sum of c / at**p less ``step`` of x, x + 1, ... up to ``at``."""
    terms = sum((F.lit(c) / F.pow(at, F.lit(float(p))) for c, p in series), F.lit(0.0))
    return terms - sum((step(x + k) for k in range(SHIFT)), F.lit(0.0))


def gammaln(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0."""
    z = x + SHIFT
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + _shifted(x, z, ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7)), F.ln)


def digamma(x: Column) -> Column:
    """First derivative of ``gammaln`` for x > 0."""
    z = x + SHIFT
    return F.ln(z) + _shifted(x, z, ((-1 / 2, 1), (-1 / 12, 2), (1 / 120, 4), (-1 / 252, 6), (1 / 240, 8)), lambda t: 1 / t)


def trigamma(x: Column) -> Column:
    """Second derivative of ``gammaln`` for x > 0."""
    return _shifted(x, x + SHIFT, ((1.0, 1), (1 / 2, 2), (1 / 6, 3), (-1 / 30, 5), (1 / 42, 7), (-1 / 30, 9)), lambda t: -1 / (t * t))


def tetragamma(x: Column) -> Column:
    """Third derivative of ``gammaln`` for x > 0."""
    return _shifted(x, x + SHIFT, ((-1.0, 2), (-1.0, 3), (-1 / 2, 4), (1 / 6, 6), (-1 / 6, 8), (3 / 10, 10)), lambda t: 2 / (t * t * t))


def normal_cdf(x: Column, terms: int = 120) -> Column:
    """Standard normal distribution function; beyond 6.5 deviations 0 or 1."""
    start = F.struct(x.alias("term"), x.alias("total"))

    def grow(held: Column, k: Column) -> Column:
        term = held["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (held["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, grow, lambda held: held["total"])
    return F.when(x > 6.5, 1.0).when(x < -6.5, 0.0).otherwise(0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total)


def normal(u: Column, v: Column) -> Column:
    """A normal variate of two uniform ones in [0, 1)."""
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def gamma(uniforms: Sequence[Column]) -> Column:
    """A gamma variate whose shape is the number of ``uniforms``; one of them gives an exponential variate."""
    return sum((-F.ln(1 - u) for u in uniforms), F.lit(0.0))


def binomial(uniforms: Sequence[Column], p: float) -> Column:
    """How many of ``uniforms`` are less than ``p``."""
    return sum(((u < p).cast("int") for u in uniforms), F.lit(0))


def categorical(u: Column, weights: Sequence[float]) -> Column:
    """Index of the class that ``u`` falls into, classes as long as their weights."""
    upto = [sum(weights[: k + 1]) / sum(weights) for k in range(len(weights) - 1)]
    return sum(((u >= x).cast("int") for x in upto), F.lit(0))


def poisson(u: Column, mean: float, most: int = 60) -> Column:
    """Inverse of the distribution function at ``u``; ``most`` must be far above ``mean``."""
    p = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(most)]
    upto = F.array(*(F.lit(sum(p[: k + 1])) for k in range(most)))
    return F.size(F.filter(upto, lambda x: x <= u))
