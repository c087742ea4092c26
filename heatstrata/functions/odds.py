"""Odds ratios, normal tail probabilities and attributable fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the multiplier of the 95% limits.
Z_95 = 1.96


def odds_ratio_columns(estimate: Column, std_error: Column) -> dict[str, Column]:
    """Odds ratio and 95% limits of a log odds ratio and its standard error."""
    return {
        "or": F.exp(estimate),
        "or_low": F.exp(estimate - F.lit(Z_95) * std_error),
        "or_high": F.exp(estimate + F.lit(Z_95) * std_error),
    }


def two_sided_p(z: str) -> Column:
    """P(|N(0,1)| >= |z|) of a column as a built-in expression, accurate in the far tail too.

    With x = |z| / sqrt(2) this is erfc(x): for small x through the series of erf, whose terms are
    all positive, and for large x through the continued fraction of erfc.
    """
    x = f"(abs({z}) / sqrt(2D))"
    scale = f"(exp(-{x} * {x}) / sqrt(pi()))"
    series = f"""aggregate(
        sequence(1, 80), named_struct('term', 1D, 'total', 1D),
        (s, k) -> named_struct(
            'term', s.term * 2 * {x} * {x} / (2 * k + 1),
            'total', s.total + s.term * 2 * {x} * {x} / (2 * k + 1)),
        s -> s.total)"""
    fraction = f"aggregate(sequence(80, 1, -1), {x}, (tail, k) -> {x} + k / 2D / tail)"
    return F.expr(
        f"CASE WHEN {x} < 2 THEN 1 - 2 * {x} * {scale} * {series} WHEN {x} >= 2 THEN {scale} / {fraction} END"
    )


def attributable_fraction(odds_ratio: Column) -> Column:
    """1 - 1/OR: negative below 1, null when the ratio is unknown or not positive."""
    return F.when(odds_ratio > 0, F.lit(1.0) - F.lit(1.0) / odds_ratio)
