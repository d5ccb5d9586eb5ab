"""Exact order statistics by counting, without sorting rows.

Values are counted per group in bins that keep their order; counts are combined before they are shuffled. Only the one
or two bins that hold the wanted ranks are looked at again, value by value. A group may be of any size, and the same
steps run for all.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.session import join_same

PER_DOUBLING = 64


def ordered_bin(value: Column) -> Column:
    """A long that never falls as a finite value rises: the sign and the logarithm of the size in small steps."""
    size = F.floor(F.log2(F.abs(value)) * PER_DOUBLING) + 1100 * PER_DOUBLING
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * size).cast("long")


#: Whole numbers that stand for the largest weight of a group have as many digits.
DIGITS = 11


def whole_weights(rows: DataFrame, by: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Add ``name``: weights as whole numbers in a unit that is a power of ten below the group's largest weight. Sums of
    them do not depend on the order of rows, and equal shares stay equal. Weights that are not positive are null."""
    by = list(by)
    w = weight.cast("double")
    w = F.when((w > 0) & (w < float("inf")), w)
    top = rows.select(*by, w.alias("_w")).groupBy(*by).agg((DIGITS - 1 - F.floor(F.log10(F.max("_w")))).alias("_p"))
    return join_same(rows, top, by).withColumn(name, F.rint(w * F.pow(F.lit(10.0), "_p")).cast("long")).drop("_p")


def median_of(rows: DataFrame, by: Sequence[str], value: Column, name: str, weight: Column | None = None, q: float = 0.5, table: DataFrame | None = None) -> DataFrame:
    """One row per group. With ``weight``: the lowest value at which the cumulative weight reaches ``q`` of the total.
    Without: the linear quantile. Rows whose value is null or not finite, or whose weight is not positive, are left
    out; groups without rows are absent. ``table``, a row per group, may hold columns that ``value`` uses; they are
    kept, and rows meet it once per pass. Weights that are not whole numbers are turned into such (``whole_weights``),
    so that sums are exact and the bin that is looked at again holds the value."""
    by = list(by)
    if weight is not None and isinstance(rows.select(weight).schema[0].dataType, T.FractionalType):
        rows, weight = whole_weights(rows, by, weight, "_units"), F.col("_units")
    total = F.sum("_w") if weight is None else F.sum(F.col("_w").cast("decimal(20,0)"))
    keep = by + ([] if table is None else [c for c in table.columns if c not in by])

    def measured(t: DataFrame | None) -> DataFrame:
        d = rows if t is None else join_same(rows, t, by)
        d = d.withColumn("_v", value.cast("double")).withColumn("_w", F.lit(1) if weight is None else weight)
        d = d.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")) & (F.col("_w") > 0))
        return d.withColumn("_at", ordered_bin(F.col("_v")))

    share = F.lit(Decimal(str(q))) * F.col("_n")
    if weight is None:
        at = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda p: (p >= F.col("_hi") - F.col("_c")) & (p < F.col("_hi"))
        wanted = holds(low) | holds(high)
    else:
        wanted = (F.col("_hi") >= share) & (F.col("_hi") - F.col("_c") < share)
    group = Window.partitionBy(*by)
    bins = measured(table).groupBy(*keep, "_at").agg(total.alias("_c"))
    bins = bins.withColumn("_hi", F.sum("_c").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(group))
    bins = bins.where(wanted).select(*keep, F.col("_at").alias("_b"), (F.col("_hi") - F.col("_c")).alias("_before"), "_n")
    seen = measured(bins).where("_at = _b").groupBy(*keep, "_b", "_before", "_n", "_v").agg(total.alias("_c"))
    seen = seen.withColumn("_hi", F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    if weight is not None:
        return seen.where(F.col("_hi") >= share).groupBy(*keep).agg(F.min("_v").alias(name))
    out = seen.groupBy(*keep).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_lo"), F.max(F.when(holds(high), F.col("_v"))).alias("_up"), F.max(at - low).alias("_f"))
    return out.select(*keep, F.when(F.col("_f") == 0, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_up") - F.col("_lo")) * F.col("_f")).alias(name))
