"""Scalar functions of the model, as column expressions inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def inv_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def bernoulli_logit(result: Column, eta: Column) -> Column:
    """Log mass of a boolean result; stable for large |eta|."""
    signed = F.when(result, eta).otherwise(-eta)
    return -(F.greatest(-signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed))))


def curve_logit(t: Column, beta1: Column, beta2: Column, beta3: Column, cutpoint: Column) -> Column:
    """Piecewise quadratic on the logit scale, with its top at the cutpoint."""
    gap = t - cutpoint
    return beta1 + F.when(gap < 0, beta2).otherwise(beta3) * gap * gap


def lognormal_log_kernel(x: Column, mu: Column, sd: Column) -> Column:
    """Log-normal log density up to a constant that does not depend on x."""
    z = (F.log(x) - mu) / sd
    return -F.log(x) - 0.5 * z * z


def normal_log_density(x: Column, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    return -0.5 * z * z - (_HALF_LOG_2PI + math.log(sd))


def hash_uniform(*keys) -> Column:
    """Reproducible uniform in (0, 1) from the values of the keys."""
    cells = 1 << 52
    return (F.pmod(F.xxhash64(*keys), F.lit(cells)) + 0.5) / float(cells)


def whole_day(x: Column) -> Column:
    """Round half to even, to an integer (so that no -0.0 becomes a group of its own)."""
    return F.rint(x).cast("int")
