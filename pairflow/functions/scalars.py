"""Scalar column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from pairflow.functions import fixed

MAX_DOUBLE = 1.7976931348623157e308


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN and NULL both mean missing; NULL is the one form used downstream."""
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A lambda evaluates what it captures anew for every element; a bound value is a
    lambda variable and is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_true(predicate: Column) -> Column:
    """Predicate with NULL read as false."""
    return F.coalesce(predicate, F.lit(False))


def is_registry_id(c: Column | str) -> Column:
    return is_true(as_column(c).rlike(fixed.REGISTRY_ID_PATTERN))


def in_range(c: Column | str, lo: float, hi: float) -> Column:
    """Half-open ``lo <= value < hi``; missing values are out of range."""
    value = nan_to_null(as_column(c).cast("double"))
    return is_true((value >= F.lit(float(lo))) & (value < F.lit(float(hi))))


def signed_error(y: Column | str, p: Column | str) -> Column:
    return as_column(y) - as_column(p)


def abs_error(y: Column | str, p: Column | str) -> Column:
    return F.abs(signed_error(y, p))


def ln_value(c: Column | str) -> Column:
    """Natural logarithm; NULL where it is undefined."""
    c = as_column(c)
    return F.when(c > 0, F.ln(c))


def nan_to_num(c: Column | str) -> Column:
    """NaN becomes 0, infinities become the largest doubles, NULL stays NULL."""
    c = as_column(c)
    return F.when(c.isNotNull(), finite(c))


def finite(c: Column) -> Column:
    """``nan_to_num`` of a value known not to be NULL; mentions it only once."""
    return F.greatest(F.lit(-MAX_DOUBLE), F.least(F.lit(MAX_DOUBLE), F.nanvl(c, F.lit(0.0))))


def round4(c: Column | str) -> Column:
    """Half-even rounding to four places."""
    return F.bround(as_column(c), 4)


def format_score(label: str, c: Column | str) -> Column:
    return F.format_string(f"{label} = %.3f", as_column(c))


def latex_row(*cells: Column | str) -> Column:
    """One table row: cells joined by ``&`` and closed by a line break mark."""
    return F.concat(F.concat_ws(" & ", *[as_column(c).cast("string") for c in cells]), F.lit(r" \\"))


def temperature_bounds(bp_1: Column | str, bp_2: Column | str) -> tuple[Column, Column]:
    """Lower and upper of two boiling points; NULL when either is missing."""
    a, b = as_column(bp_1), as_column(bp_2)
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, F.least(a, b)), F.when(known, F.greatest(a, b))


def mixture_key(*ids: Column | str) -> Column:
    return F.concat_ws(fixed.ID_SEPARATOR, *[as_column(c).cast("string") for c in ids])


def flatten_lists(c: Column | str) -> Column:
    return F.flatten(as_column(c))


def first_category(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern occurs in the text, else ``""``."""
    c = as_column(c)
    hits = [F.when(c.rlike(pattern), F.lit(label)) for label, pattern in rules]
    return F.coalesce(*hits, F.lit(""))


def seeded_hash(c: Column | str, seed: int) -> Column:
    """Deterministic 32-digit hexadecimal hash of ``seed:value``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_column(c).cast("string")).cast("binary"))


def hash_fraction(c: Column | str, seed: int) -> Column:
    """Seeded hash as a double in [0, 1): 13 hex digits are exact in a double."""
    digits = F.conv(F.substring(seeded_hash(c, seed), 1, 13), 16, 10).cast("double")
    return digits / F.lit(float(16**13))


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)
