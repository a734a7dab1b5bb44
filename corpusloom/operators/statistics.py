"""Mean, sample variance and deviation, as of timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, mean, variance and deviation (of a sample), relative deviation; a group of one has null for the last three."""
    d = F.stddev_samp(value)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), d.alias("deviation"), F.try_divide(d, F.avg(value)).alias("relative"))
