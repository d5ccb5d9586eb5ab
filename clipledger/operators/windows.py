"""Ordered operators: lagged change, rolling outliers, runs, cuts, unwrapping, closure, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import arrays
from clipledger.functions.scoring import clip
from clipledger.operators.groups import by_group
from clipledger.session import join_same, settle


def lag_change(df: DataFrame, by: Sequence[str], order: Sequence, vector: str, name: str = "change") -> DataFrame:
    """Mean absolute difference of a descriptor from the previous row; 0 on the first."""
    change = lambda w: F.coalesce(arrays.mean_abs_diff(vector, F.lag(vector).over(w)), F.lit(0.0))
    return by_group(df, by, lambda d, g: g.slide(d, order, 1, 0, **{name: change}))


def rolling_outlier(df: DataFrame, by: Sequence[str], order: Sequence, value: str, half: int = 4, limit: float = 0.30) -> DataFrame:
    """Flag rows that deviate from the centred rolling median; windows shrink at the ends, no row is dropped."""
    med = lambda w: F.percentile(F.col(value).cast("double"), F.lit(0.5)).over(w.rowsBetween(-half, half))
    d = by_group(df, by, lambda d, g: g.slide(d, order, half, half, rolling_median=med))
    far = F.try_divide(F.abs(F.col(value) - F.col("rolling_median")), F.col("rolling_median")) > limit
    return d.withColumn("outlier", F.coalesce((F.col("rolling_median") > 0) & far, F.lit(False)))


def jump_fraction(df: DataFrame, by: Sequence[str], order: Sequence, cols: Sequence[str], limit: float = 0.55) -> DataFrame:
    """Share of consecutive rows whose summed absolute change exceeds ``limit``; 0 with fewer than two rows."""
    jump = lambda w: sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in cols), F.lit(0.0))
    d = by_group(df, by, lambda d, g: g.slide(d, order, 1, 0, _jump=jump))
    share = F.avg(F.when(F.col("_jump").isNotNull(), (F.col("_jump") > limit).cast("double")))
    return d.groupBy(*by).agg(F.coalesce(share, F.lit(0.0)).alias("jump_fraction"))


def temporal_runs(df: DataFrame, by: Sequence[str], time: str, order: Sequence, gap) -> DataFrame:
    """Add ``run``: a new one starts when the time since the previous row exceeds ``gap``."""

    def step(d, g):
        d = g.slide(d, [time, *order], 1, 0, _gap=lambda w: F.col(time) - F.lag(time).over(w))
        new = F.when(F.col("_gap") > gap, 1).otherwise(0).cast("long")
        return g.running(d, [time, *order], run=new).drop("_gap")

    return by_group(df, by, step)


def stable_run(df: DataFrame, by: Sequence[str], time: str, order: Sequence, gap, aspect: Column, strict: Column, score: str,
               min_rows: int = 3, max_deviation: float = 0.28) -> tuple[DataFrame, DataFrame]:
    """Best aspect-consistent run per group, and its member rows.

    Rows far from the run's median aspect are trimmed; runs need ``min_rows`` and one strict row and compete by
    (rows, strict rows, median score, duration, earliest start).
    """
    by = list(by)
    a = F.greatest(F.greatest(aspect, F.lit(1e-6)), 1 / F.greatest(aspect, F.lit(1e-6)))
    d = settle(temporal_runs(df.withColumn("_aspect", a).withColumn("_strict", strict.cast("int")), by, time, order, gap))
    d = by_group(d, by + ["run"], lambda d, g: g.attach_quantiles(d, median_aspect=(F.col("_aspect"), 0.5)))
    kept = d.where(F.abs(F.log(F.col("_aspect") / F.col("median_aspect"))) <= max_deviation)
    stats = kept.groupBy(*by, "run").agg(
        F.count("*").alias("rows"), F.sum("_strict").alias("strict_rows"), (F.max(time) - F.min(time)).alias("duration"),
        F.min(time).alias("start"), F.max("median_aspect").alias("median_aspect"),
    )
    med = by_group(kept, by + ["run"], lambda d, g: g.quantiles(d, median_score=(F.col(score).cast("double"), 0.5)))
    stats = join_same(stats, med, by + ["run"]).where((F.col("rows") >= min_rows) & (F.col("strict_rows") > 0))
    row = F.struct("run", "rows", "strict_rows", "median_score", "duration", "start", "median_aspect")
    key = F.struct("rows", "strict_rows", "median_score", "duration", -F.col("start"))
    best = stats.groupBy(*by).agg(F.max_by(row, key).alias("_b")).select(*by, "_b.*")
    members = join_same(kept.drop("median_aspect"), best.select(*by, "run", "median_aspect"), by + ["run"])
    return best, members.drop("_aspect", "_strict")


def _affinity_distance(p: Column, q: Column) -> Column:
    both = arrays.total(F.zip_with(p, q, lambda x, y: F.sqrt(x * y)))
    affinity = F.try_divide(both, F.sqrt(arrays.total(p) * arrays.total(q)))
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(affinity, F.lit(0.0)))))


def scene_cuts(frames: DataFrame, by: Sequence[str], order: Sequence, time: str, duration: Column, hist: str, colour: str,
               cut=0.72, colour_change=0.25, context=0.58, edge=0.05, needed=3) -> DataFrame:
    """Transitions to the next frame with distances and a ``verdict``: cut, boundary or null.

    ``hist`` is a fixed-length array of bin weights, ``colour`` an array of values in 0..1. A cut needs a large
    histogram distance, colour change and context distance (three frames either side), and enough frames on both
    sides when it lies in the first or last 5 % of the clip.
    """
    d = frames.withColumn("_h", arrays.normalised(hist))

    def context_of(w, offsets):
        near = [F.lead("_h", o).over(w) if o > 0 else F.lag("_h", -o).over(w) if o < 0 else F.col("_h") for o in offsets]
        zero = F.transform(F.col("_h"), lambda x: F.lit(0.0))
        out = zero
        for n in near:
            out = F.zip_with(out, F.coalesce(n, zero), lambda x, y: x + y)
        return out

    def step(d, g):
        d = g.slide(
            d, order, 2, needed,
            next_time=lambda w: F.lead(time).over(w),
            hist_distance=lambda w: _affinity_distance(F.col("_h"), F.lead("_h").over(w)),
            colour_mad=lambda w: arrays.mean_abs_diff(colour, F.lead(colour).over(w)),
            context_distance=lambda w: _affinity_distance(context_of(w, [-2, -1, 0]), context_of(w, [1, 2, 3])),
        )
        return g.attach(g.rank(d, order, "_i"), _n=F.count("*"))

    d = by_group(d, by, step).where((F.col("_n") >= 6) & F.col("next_time").isNotNull())
    d = d.withColumn("position", F.col("next_time") / F.greatest(duration, F.lit(1e-6)))
    extreme = (F.col("hist_distance") >= cut) & (F.col("colour_mad") >= colour_change) & (F.col("context_distance") >= context)
    interior = F.col("position").between(edge, 1 - edge)
    enough = (F.col("_i") >= needed) & (F.col("_n") - F.col("_i") >= needed)
    verdict = F.when(extreme & (interior | enough), "cut").when(extreme, "boundary")
    return d.withColumn("verdict", verdict).drop("_h", "_i", "_n")


def unwrap(df: DataFrame, by: Sequence[str], order: Sequence, angle: Column, name: str = "unwrapped") -> DataFrame:
    """Continuous angle in degrees: steps are taken the short way round and summed."""

    def step(d, g):
        d = g.slide(d.withColumn("_a", angle.cast("double")), order, 1, 0, _d=lambda w: F.col("_a") - F.lag("_a").over(w))
        short = F.pmod(F.col("_d") + 180, F.lit(360.0)) - 180
        short = F.when((short == -180) & (F.col("_d") > 0), 180.0).otherwise(short)
        return g.running(d, order, **{name: F.coalesce(short, F.col("_a"))}).drop("_a", "_d")

    return by_group(df, by, step)


def loop_closure(df: DataFrame, by: Sequence[str], order: Sequence, similarity: str, closure=0.86, start=0.60) -> DataFrame:
    """Frame of the tail most similar to the first frame after 5-row smoothing, and the sweep it implies."""

    def smooth(w):
        back1, ahead1 = F.coalesce(F.lag(similarity, 1).over(w), F.col(similarity)), F.coalesce(F.lead(similarity, 1).over(w), F.col(similarity))
        back2, ahead2 = F.coalesce(F.lag(similarity, 2).over(w), back1), F.coalesce(F.lead(similarity, 2).over(w), ahead1)
        return (back2 + back1 + F.col(similarity) + ahead1 + ahead2) / 5

    def step(d, g):
        d = g.rank(g.slide(d, order, 2, 2, _s=smooth), order, "_i")
        return g.attach(d.withColumn("_s", F.round("_s", 12)), _n=F.count("*"))  # equal sums are equal numbers

    d = by_group(df, by, step)
    first = F.least(F.greatest(F.rint(start * (F.col("_n") - 1)), F.lit(1)), F.col("_n") - 1)
    tail = d.where(F.col("_i") - 1 >= first)
    peak = tail.groupBy(*by).agg(
        F.max_by(F.col("_i") - 1, F.struct("_s", -F.col("_i"))).alias("closure_frame"), F.max("_s").alias("peak"), F.max("_n").alias("frames"))
    closed = F.col("peak") > closure
    sweep = F.when(closed, 360.0 * (F.col("frames") - 1) / F.col("closure_frame")).otherwise(240.0)
    return peak.withColumn("closed", closed).withColumn("sweep_degrees", clip(sweep, 90.0, 400.0))


def interpolate_asof(rows: DataFrame, anchors: DataFrame, by: Sequence[str], time: str, order: Sequence[str], angle: str, held: Sequence[str], cap: float = 45.0) -> DataFrame:
    """Values at the rows' times from the bracketing anchors: linear inside; past either end ``held`` stay and
    ``angle`` moves on with the local velocity, by at most ``cap``. Anchor times are distinct per group."""
    by, held = list(by), list(held)
    fields = [time, angle, *held]
    a = anchors.select(*by, *fields)

    def neighbours(d, g):
        return g.slide(d, [time], 1, 1, _prev=lambda w: F.lag(F.struct(time, angle)).over(w), _next=lambda w: F.lead(F.struct(time, angle)).over(w))

    a = by_group(a, by, neighbours).select(*by, time, F.struct(*fields, "_prev", "_next").alias("_a"))
    r = rows.select(*by, time, *order, F.lit(1).alias("_row"))
    u = r.unionByName(a, allowMissingColumns=True)

    def fill(d, g):
        # anchors come first among equal times in both directions, so an exact match brackets itself
        d = g.carry(d, [time, F.col("_row").asc_nulls_first(), *order], _lo=F.col("_a"))
        return g.carry(d, [F.col(time).desc(), F.col("_row").asc_nulls_first(), *order], _hi=F.col("_a"))

    d = by_group(u, by, fill).where("_row = 1")
    lo, hi, t = F.col("_lo"), F.col("_hi"), F.col(time)
    span = hi[time] - lo[time]
    part = F.when(span > 0, (t - lo[time]) / span).otherwise(0.0)

    def beyond(end, other):
        v = F.coalesce((end[angle] - end[other][angle]) / (end[time] - end[other][time]), F.lit(0.0))
        return end[angle] + clip(v * (t - end[time]), -cap, cap)

    moved = F.when(lo.isNull(), beyond(hi, "_next")).when(hi.isNull(), beyond(lo, "_prev")).otherwise(lo[angle] + part * (hi[angle] - lo[angle]))
    others = [F.when(lo.isNull(), hi[c]).when(hi.isNull(), lo[c]).otherwise(lo[c] + part * (hi[c] - lo[c])).alias(c) for c in held]
    side = F.when(lo.isNull(), "before").when(hi.isNull(), "after").otherwise("inside")
    return d.select(*by, time, *order, moved.alias(angle), *others, side.alias("side"))
