"""Small column expressions shared by reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """Division that gives null on a zero denominator, also in ANSI mode."""
    return F.try_divide(_column(a).cast("double"), _column(b).cast("double"))


def ratio_or_zero(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def at_least(c: Column | str, low: float) -> Column:
    """Lower bound that keeps nulls (`greatest` alone would skip them)."""
    return F.when(_column(c).isNotNull(), F.greatest(_column(c), F.lit(low)))


def at_most(c: Column | str, high: float) -> Column:
    """Upper bound that keeps nulls."""
    return F.when(_column(c).isNotNull(), F.least(_column(c), F.lit(high)))


def log1p_nonnegative(c: Column | str) -> Column:
    return F.log1p(at_least(c, 0.0))


def log10_from_one(c: Column | str) -> Column:
    return F.log10(at_least(c, 1.0))


def neg_log10_p(c: Column | str, floor: float = 1e-300) -> Column:
    return -F.log10(at_least(c, floor))


def p_label(c: Column | str) -> Column:
    """Display text of a p value: blank, `< 0.001` or three decimals."""
    p = _column(c)
    return (F.when(p.isNull() | F.isnan(p), F.lit(""))
            .when(p < 0.001, F.lit("< 0.001"))
            .otherwise(F.format_string("%.3f", p)))


def interval_label(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """`+0.0012 [-0.0001, +0.0025]`."""
    return F.format_string("%+.4f [%+.4f, %+.4f]", _column(value), _column(low), _column(high))


def quartile_label(c: Column | str, name: str, cuts: list[float]) -> Column:
    """Interval text of the quartile bin a value falls in, such as `x <= 9.17` or `9.17 < x <= 12.50`.

    Bounds are distinct and ascending; a value equal to a bound belongs to the lower bin.
    """
    value = _column(c)
    bounds = sorted(set(cuts))
    label = F.when(value <= bounds[0], F.lit(f"{name} <= {bounds[0]:.2f}"))
    for low, high in zip(bounds, bounds[1:]):
        label = label.when(value <= high, F.lit(f"{low:.2f} < {name} <= {high:.2f}"))
    return label.when(value.isNotNull(), F.lit(f"{name} > {bounds[-1]:.2f}"))
