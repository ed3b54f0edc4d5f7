"""Z-score outliers.

The population mean and deviation are one global aggregate (partial per partition, then a
single tiny merge); the two numbers come back as literals and the filter runs where the data
is. No window over the whole table, no cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ZSCORE_THRESHOLD


def zscore_outliers(df: DataFrame, value: str, threshold: float = ZSCORE_THRESHOLD) -> DataFrame:
    """Rows of ``df`` whose ``|z|`` of ``value`` exceeds ``threshold``, with a ``z`` column.

    Rows missing the value are skipped; a zero deviation gives no outliers.
    """
    v = F.col(value).cast("double")
    present = df.filter(v.isNotNull() & ~F.isnan(v))
    stats = present.agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd")).first()
    if stats is None or stats["mu"] is None or not stats["sd"]:
        return present.withColumn("z", F.lit(None).cast("double")).filter(F.lit(False))
    z = (v - F.lit(float(stats["mu"]))) / F.lit(float(stats["sd"]))
    return present.withColumn("z", z).filter(F.abs(F.col("z")) > F.lit(float(threshold)))
