"""Running sums and numbers over groups of any size, by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import written


def with_running(df: DataFrame, size: str, keys: list[str], order: list[str], into: str) -> DataFrame:
    """Add the sum of ``size`` over the rows before each row of the same ``keys``, by ``order``.

    Rows are dealt to ranges of about equal numbers and summed inside; the sums of the ranges, one row for
    each range and key, meet in a window. The ranged rows are written, so that they are dealt once.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    ranged = written(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    whole = lambda *columns: Window.partitionBy(*keys, *columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(size).alias("_sum"))
    totals = totals.withColumn("_before", F.sum("_sum").over(whole().orderBy("_range")) - F.col("_sum")).drop("_sum")
    inside = ranged.withColumn(into, F.sum(size).over(whole("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - F.col(size))
    on = inside["_range"] == totals["_range"]
    for k in keys:
        on = on & inside[k].eqNullSafe(totals[k])
    columns = [inside[c] for c in df.columns]
    return inside.join(totals, on).select(*columns, (F.col(into) + F.col("_before")).cast("long").alias(into))
