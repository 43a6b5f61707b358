"""Rates, facets and weighted means. What wasn't measured is null, never zero and never NaN."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den; null without a denominator."""
    return F.when(den != 0, num / F.nullif(den, F.lit(0)))


def capped(edits: Column, n_ref: Column) -> Column:
    """A page's edits, which can't cost more than all of it."""
    return F.least(edits, n_ref)


def f1(kept: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Null if neither side has any; 0 where nothing was kept."""
    recall, precision = F.coalesce(ratio(kept, n_ref), F.lit(0.0)), F.coalesce(ratio(kept, n_hyp), F.lit(0.0))
    both = recall + precision
    return F.when((n_ref == 0) & (n_hyp == 0), None).when(both == 0, 0.0).otherwise(2 * recall * precision / F.nullif(both, F.lit(0.0)))


def mean_present(*facets: Column) -> Column:
    """The mean of the facets that aren't null; null if all are."""
    n = sum((f.isNotNull().cast("int") for f in facets), F.lit(0))
    return ratio(sum((F.coalesce(f.cast("double"), F.lit(0.0)) for f in facets), F.lit(0.0)), n)


def weighted_mean(facets: dict[str, Column], weights: dict[str, float]) -> Column:
    """The mean of the facets that aren't null, their weights made to add up to 1."""
    total = sum((F.when(facets[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return ratio(sum((F.coalesce(facets[k] * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)), total)


def log_facet(value: Column, floor: float, ceiling: float) -> Column:
    """1 at floor or below, 0 at ceiling or above, linear in the logarithm between; null for null, NaN and what isn't positive."""
    v = F.when(value.isNotNull() & ~F.isnan(value.cast("double")) & (value > 0), value)
    top, bottom = F.log10(F.lit(float(ceiling))), F.log10(F.lit(float(floor)))
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top - F.log10(v)) / (top - bottom))))


def printed(value: Column, decimals: int) -> Column:
    """A number as printed: rounded half to even on its exact binary value.

    Spark's own formatting and rounding go by the shortest decimal form, so 2.675 would print as 2.68. An Arrow UDF, for the few rows of a
    result table.
    """
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if pd.isna(x) else f"{x:.{decimals}f}").astype(object)

    return F.pandas_udf(run, "string")(value.cast("double"))
