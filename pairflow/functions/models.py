"""Curve models as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from pairflow.functions.scalars import as_column, finite


def polynomial(x: Column | str, coefficients: list[Column | str]) -> Column:
    """``sum c[j] * x**j`` by Horner's rule, lowest power first."""
    x = as_column(x)
    cs = [as_column(c) for c in coefficients]
    return reduce(lambda acc, c: acc * x + c, reversed(cs[:-1]), cs[-1])


def nrtl_ln_gamma(
    a12: Column | str,
    t12: Column | str,
    t21: Column | str,
    x1: Column | str,
    x2: Column | str,
    a21: Column | str | None = None,
) -> tuple[Column, Column]:
    """Two-component non-random two-liquid logarithmic activity coefficients.

    A zero denominator can only meet a zero squared mole fraction in front of it,
    so the undefined product counts as 0, like every NaN.
    """
    a12, t12, t21, x1, x2 = map(as_column, (a12, t12, t21, x1, x2))
    a21 = a12 if a21 is None else as_column(a21)
    return nrtl_from_factors(F.exp(-a12 * t12), F.exp(-a21 * t21), t12, t21, x1, x2)


def nrtl_from_factors(g12: Column, g21: Column, t12: Column, t21: Column, x1: Column, x2: Column) -> tuple[Column, Column]:
    """The same from the two exponential factors, for callers that stage them."""
    d1, d2 = x1 + x2 * g21, x2 + x1 * g12
    r1, r2 = F.try_divide(g21, d1), F.try_divide(g12, d2)
    ln_1 = x2 * x2 * (t21 * r1 * r1 + F.try_divide(t12 * g12, d2 * d2))
    ln_2 = x1 * x1 * (t12 * r2 * r2 + F.try_divide(t21 * g21, d1 * d1))
    known = x1.isNotNull() & x2.isNotNull()
    return tuple(F.when(known, finite(F.coalesce(v, F.lit(0.0)))) for v in (ln_1, ln_2))
