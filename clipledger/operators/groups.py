"""Group-wise work that stays exact when one group holds a large share of the rows.

An operator is written once as ``step(df, groups)`` and run through :func:`by_group`. Groups of up to
``hot_limit`` rows use plain Spark windows (:class:`Whole`). Larger groups are taken out and use
:class:`Split`: rows are range-partitioned by (key, order), ranked across partitions, and windows run on
fixed-size blocks of ranks, so that no task ever holds a whole hot group. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.session import hot_limit, join_same, settle

PART_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits
BROADCAST_KEYS = 100_000


def _columns(order: Sequence) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


class Whole:
    """Every group fits one task: ordinary window functions."""

    def __init__(self, by: Sequence[str]):
        self.by = list(by)

    def _over(self, order: Sequence = ()):
        spec = Window.partitionBy(*self.by)
        return spec.orderBy(*_columns(order)) if order else spec

    def rank(self, df: DataFrame, order: Sequence, name: str = "rn") -> DataFrame:
        return df.withColumn(name, F.row_number().over(self._over(order)).cast("long"))

    def attach(self, df: DataFrame, **aggs: Column) -> DataFrame:
        """Add group aggregates to every row."""
        return df.select("*", *[a.over(self._over()).alias(n) for n, a in aggs.items()])

    def slide(self, df: DataFrame, order: Sequence, before: int, after: int, **cols: Callable) -> DataFrame:
        """Add expressions over a frame that reaches ``before``/``after`` rows; each gets the window."""
        w = self._over(order)
        return df.select("*", *[f(w).alias(n) for n, f in cols.items()])

    def running(self, df: DataFrame, order: Sequence, **cols: Column) -> DataFrame:
        """Add running sums up to and including the row."""
        w = self._over(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in cols.items()])

    def carry(self, df: DataFrame, order: Sequence, **cols: Column) -> DataFrame:
        """Add the last non-null value up to and including the row."""
        w = self._over(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in cols.items()])

    def quantiles(self, df: DataFrame, **cols: tuple[Column, float]) -> DataFrame:
        """One row per group with exact linear quantiles: ``name=(column, q)``."""
        return df.groupBy(*self.by).agg(*[F.percentile(c, q).alias(n) for n, (c, q) in cols.items()])

    def attach_quantiles(self, df: DataFrame, **cols: tuple[Column, float]) -> DataFrame:
        return self.attach(df, **{n: F.percentile(c, q) for n, (c, q) in cols.items()})

    def fix(self, df: DataFrame) -> DataFrame:
        """Cut the plan of a long loop."""
        return settle(df)


class Split:
    """Groups too large for one task: global ranks and block-wise windows. Helper columns start with two underscores,
    so that they cannot meet an operator's own. What holds a row per group, block or partition is small, as each such
    group has many rows; it is broadcast, since a join shuffled by group would bring a whole group into one task."""

    def __init__(self, by: Sequence[str], block: int):
        self.by, self.block = list(by), max(int(block), 1)

    def rank(self, df: DataFrame, order: Sequence, name: str = "rn") -> DataFrame:
        keys = _columns(order)
        spark = df.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = settle(
            df.repartitionByRange(parts, *[F.col(b) for b in self.by], *keys)
            .sortWithinPartitions(*[F.col(b) for b in self.by], *keys)
            .withColumn("__at", F.monotonically_increasing_id())
            .withColumn("__part", F.shiftright("__at", PART_BITS))
        )
        starts = placed.groupBy(*self.by, "__part").agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
        upto = Window.partitionBy(*self.by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
        out = join_same(placed, F.broadcast(starts), self.by + ["__part"])
        return out.withColumn(name, F.col("__at") - F.col("__start") + F.col("__before") + 1).drop(
            "__at", "__part", "__start", "__n", "__before"
        )

    def attach(self, df: DataFrame, **aggs: Column) -> DataFrame:
        df = settle(df)
        return join_same(df, F.broadcast(df.groupBy(*self.by).agg(*[a.alias(n) for n, a in aggs.items()])), self.by)

    def slide(self, df: DataFrame, order: Sequence, before: int, after: int, **cols: Callable) -> DataFrame:
        size = max(self.block, before + after + 1)
        ranked = self.rank(df, order, "__rn").withColumn("__own", F.expr(f"(__rn - 1) div {size}"))
        # a row is copied into the next block if that block looks back to it, and likewise forward
        off = (F.col("__rn") - 1) % size
        homes = F.filter(
            F.array(
                F.col("__own"),
                F.when(off >= size - before, F.col("__own") + 1),
                F.when((off < after) & (F.col("__own") > 0), F.col("__own") - 1),
            ),
            lambda x: x.isNotNull(),
        )
        spread = ranked.withColumn("__blk", F.explode(homes))
        w = Window.partitionBy(*self.by, "__blk").orderBy("__rn")
        out = spread.select("*", *[f(w).alias(n) for n, f in cols.items()])
        return out.where(F.col("__blk") == F.col("__own")).drop("__rn", "__own", "__blk")

    def _blocks(self, df: DataFrame, order: Sequence) -> DataFrame:
        return self.rank(df, order, "__rn").withColumn("__blk", F.expr(f"(__rn - 1) div {self.block}"))

    def running(self, df: DataFrame, order: Sequence, **cols: Column) -> DataFrame:
        d = settle(self._blocks(df, order))
        inside = Window.partitionBy(*self.by, "__blk").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
        earlier = Window.partitionBy(*self.by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
        sums = d.groupBy(*self.by, "__blk").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in cols.items()])
        sums = sums.select(
            *self.by, "__blk", *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__p_{n}") for n in cols]
        )
        d = d.select("*", *[F.sum(c).over(inside).alias(f"__i_{n}") for n, c in cols.items()])
        d = join_same(d, F.broadcast(sums), self.by + ["__blk"])
        d = d.select("*", *[(F.coalesce(f"__i_{n}", F.lit(0)) + F.col(f"__p_{n}")).alias(n) for n in cols])
        return d.drop("__rn", "__blk", *[f"__i_{n}" for n in cols], *[f"__p_{n}" for n in cols])

    def carry(self, df: DataFrame, order: Sequence, **cols: Column) -> DataFrame:
        d = settle(self._blocks(df, order))
        inside = Window.partitionBy(*self.by, "__blk").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
        earlier = Window.partitionBy(*self.by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
        tails = d.groupBy(*self.by, "__blk").agg(
            *[F.max_by(c, F.when(c.isNotNull(), F.col("__rn"))).alias(f"__s_{n}") for n, c in cols.items()]
        )
        tails = tails.select(
            *self.by, "__blk", *[F.last(f"__s_{n}", ignorenulls=True).over(earlier).alias(f"__p_{n}") for n in cols]
        )
        d = d.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"__i_{n}") for n, c in cols.items()])
        d = join_same(d, F.broadcast(tails), self.by + ["__blk"])
        d = d.select("*", *[F.coalesce(f"__i_{n}", f"__p_{n}").alias(n) for n in cols])
        return d.drop("__rn", "__blk", *[f"__i_{n}" for n in cols], *[f"__p_{n}" for n in cols])

    def quantiles(self, df: DataFrame, **cols: tuple[Column, float]) -> DataFrame:
        out = df.select(*self.by).distinct()
        for n, (c, q) in cols.items():
            values = df.select(*self.by, c.cast("double").alias("_v")).where("_v IS NOT NULL")
            # equal values are merged first, so that copies cost nothing
            counted = values.groupBy(*self.by, "_v").agg(F.count("*").alias("_c"))
            cum = self.running(counted, ["_v"], _hi=F.col("_c"))
            total = counted.groupBy(*self.by).agg(F.sum("_c").alias("_n"))
            at = F.lit(float(q)) * (F.col("_n") - 1)
            lo, hi = F.floor(at), F.ceil(at)
            inside = lambda p: (p >= F.col("_hi") - F.col("_c")) & (p < F.col("_hi"))
            picked = (
                join_same(cum, F.broadcast(total), self.by)
                .groupBy(*self.by)
                .agg(
                    F.max(F.when(inside(lo), F.col("_v"))).alias("_a"),
                    F.max(F.when(inside(hi), F.col("_v"))).alias("_b"),
                    F.max(at - lo).alias("_f"),
                )
            )
            picked = picked.select(
                *self.by, (F.col("_a") * (1 - F.col("_f")) + F.col("_b") * F.col("_f")).alias(n)
            )
            out = join_same(out, F.broadcast(picked), self.by, "left")
        return out

    def attach_quantiles(self, df: DataFrame, **cols: tuple[Column, float]) -> DataFrame:
        df = settle(df)
        return join_same(df, F.broadcast(self.quantiles(df, **cols)), self.by)

    def fix(self, df: DataFrame) -> DataFrame:
        return settle(df)


def by_group(df: DataFrame, by: Sequence[str], step: Callable, limit: int | None = None) -> DataFrame:
    """Run ``step(df, groups)`` with windows where groups are small and split work where they are not."""
    limit = hot_limit(df.sparkSession) if limit is None else limit
    by = list(by)
    if not by:
        return by_group(df.withColumn("_all", F.lit(0)), ["_all"], step, limit).drop("_all")
    hot = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*by)
    if hot.isEmpty():
        return step(df, Whole(by))
    hot = settle(hot)
    if hot.count() <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold = step(join_same(df, hot, by, "left_anti"), Whole(by))
    return cold.unionByName(step(join_same(df, hot, by, "left_semi"), Split(by, limit)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int, name: str = "rn") -> DataFrame:
    """First ``k`` rows per group. For k up to the session's group-limit threshold, the filter on row_number plans a
    limit before the shuffle, so a hot group sends at most ``k`` rows per map task; beyond it, hot groups are ranked
    across tasks."""
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return by_group(df, by, lambda d, g: g.rank(d, order, name)).where(F.col(name) <= k)
    w = Window.partitionBy(*by).orderBy(*_columns(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def weighted_quantile(df: DataFrame, by: Sequence[str], value: Column, weight: Column, q: float, name: str) -> DataFrame:
    """Lowest value whose cumulative weight reaches ``q`` of the total; rows with weight <= 0 are left out."""
    d = df.select(*by, value.alias("_v"), weight.alias("_w")).where("_w > 0 AND _v IS NOT NULL AND NOT isnan(_v)")
    d = d.groupBy(*by, "_v").agg(F.sum("_w").alias("_w"))

    def step(d, g):
        d = g.attach(g.running(d, ["_v"], _cum=F.col("_w")), _tot=F.sum("_w"))
        return d.where(F.col("_cum") >= q * F.col("_tot")).groupBy(*g.by).agg(F.min("_v").alias(name))

    return by_group(d, by, step)
