"""Column functions that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Coefficients of Acklam's rational approximation of the inverse normal distribution function.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
ACKLAM_TAIL = 0.02425


def equal_bins(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of x among equal bins from lo to hi; hi falls in the last, and all in bin 0 where lo is hi."""
    return F.when(hi > lo, F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def natural_log(x: str | Column) -> Column:
    """Natural logarithm as IEEE has it: -infinity at 0, NaN below, null of null."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1 (relative error about 1e-9)."""
    q = p - 0.5
    middle = q * _polynomial(q * q, ACKLAM_A) / _polynomial(q * q, ACKLAM_B)
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = _polynomial(tail, ACKLAM_C) / _polynomial(tail, ACKLAM_D)
    return F.when(p < ACKLAM_TAIL, outer).when(p > 1 - ACKLAM_TAIL, -outer).otherwise(middle)


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only, not on the partitioning."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number that depends on the keys and the seed only."""
    return inverse_normal(uniform(seed, *keys))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
