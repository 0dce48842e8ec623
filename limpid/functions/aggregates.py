"""Aggregate expressions that differ from Spark's own definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_count(v: Column) -> Column:
    return F.count_if(v.isNull())


def sample_skewness(v: Column) -> Column:
    """Bias-corrected skewness.  Spark's skewness() is the population form.

    Constant values give 0.0; fewer than three values give NULL.
    """
    n = F.count(v).cast("double")
    corrected = F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.min(v) == F.max(v), F.lit(0.0)).otherwise(corrected)
