"""Deterministic splits, even samples, de-duplication and held-out roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.scoring import track_weight
from clipledger.operators.groups import by_group
from clipledger.session import join_same, settle

SEED = "calibration-split-1"


def hash_split(df: DataFrame, by: Sequence[str], token: Column, fraction: float = 0.67, seed: str = SEED) -> DataFrame:
    """Distinct tokens ranked by sha256(seed ‖ 0 ‖ token); the first ``round(n·fraction)`` (at least one, at most
    n-1) calibrate, the rest evaluate. The rank is exact and spread over tasks, also without groups."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie strictly between 0 and 1")
    d = df.select(*by, token.alias("token")).distinct()
    d = settle(d.withColumn("digest", F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col("token")), 256)))  # counted, then ranked

    def step(d, g):
        d = g.attach(g.rank(d, ["digest", "token"], "rank"), _n=F.count("*"))
        count = F.when(F.col("_n") < 2, F.col("_n")).otherwise(F.least(F.greatest(F.rint(F.col("_n") * fraction), F.lit(1)), F.col("_n") - 1))
        return d.withColumn("role", F.when(F.col("rank") <= count, "calibration").otherwise("evaluation")).drop("_n")

    return by_group(d, by, step)


def split_digest(split: DataFrame, by: Sequence[str]) -> DataFrame:
    """SHA-256 digest of each role's tokens, whatever the order of the rows: tokens and digest per role."""
    from clipledger.operators.lineage import freeze

    return freeze(split, [*by, "role"], "token", F.lit("")).withColumnRenamed("rows", "tokens")


def _on_grid(rank: Column, n: Column, count: Column, interior: bool) -> Column:
    """Whether zero-based ``rank`` is a rounded point of ``linspace(0, n-1, count)``; with ``interior`` the grid has
    two more points and its ends are left out. Only the two nearest grid numbers can round to a rank."""
    steps = (count + 1) if interior else (count - 1)
    pace = (n - 1) / F.greatest(steps, F.lit(1))
    near = rank / F.when(pace > 0, pace).otherwise(1.0)
    low, high = (F.lit(1), count) if interior else (F.lit(0), count - 1)

    def hit(j):
        return (j >= low) & (j <= high) & (F.rint(j * pace) == rank)

    return hit(F.floor(near)) | hit(F.ceil(near))


def even_sample(df: DataFrame, by: Sequence[str], order: Sequence, count: int) -> DataFrame:
    """Evenly spaced rows per group; groups of up to ``count`` rows are kept whole."""

    def step(d, g):
        d = g.attach(g.rank(d, order, "_i"), _n=F.count("*"))
        keep = (F.col("_n") <= count) | _on_grid(F.col("_i") - 1, F.col("_n"), F.lit(count), False)
        return d.where(keep).drop("_i", "_n")

    return by_group(df, by, step)


def assign_holdout(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """Mark evenly spaced interior rows as held out, never for fitting: min(max(3, n div 6), max(0, n-8)) of them."""

    def step(d, g):
        d = g.attach(g.rank(d, order, "_i"), _n=F.count("*"))
        count = F.least(F.greatest(F.lit(3), F.floor(F.col("_n") / 6)), F.greatest(F.lit(0), F.col("_n") - 8))
        held = (count > 0) & _on_grid(F.col("_i") - 1, F.col("_n"), count, True)
        role = F.when(held, "holdout").otherwise("reconstruction")
        return d.withColumn("evaluation_role", role).withColumn("used_for_geometry", ~held).drop("_i", "_n")

    return by_group(df, by, step)


def dedup_observations(obs: DataFrame, by: Sequence[str], token: str, keep: Sequence[str], *, z: Column, track: Column, error: Column,
                       u: Column, v: Column, width: Column, height: Column, on_mask: Column) -> DataFrame:
    """Usable observations, one per (group, token): lowest error, longest track, then u, v, z. Adds ``weight``."""
    inside = (u >= 0) & (v >= 0) & (u < width - 1) & (v < height - 1)
    good = obs.where((z > 1e-9) & (track >= 2) & (error <= 4.0) & inside & on_mask)
    row = F.struct(error.alias("error"), (-track).alias("_t"), u.alias("u"), v.alias("v"), z.alias("z"), *keep)
    d = good.groupBy(*by, token).agg(F.min(row).alias("_r")).select(*by, token, "_r.*").withColumn("track_length", -F.col("_t"))
    return d.withColumn("weight", track_weight(F.col("track_length"), F.col("error"))).drop("_t")


def union_tagged(frames: dict[str, DataFrame], tag: str = "provenance") -> DataFrame:
    """Union of like tables with the name of their source."""
    out = None
    for name, df in sorted(frames.items()):
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def common_names(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows present in every table."""
    out = frames[0]
    for df in frames[1:]:
        out = out.intersect(df)
    return out


def difference(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected rows that are not present."""
    return expected.subtract(present)


def merge_ordered(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Distinct values per group in order of first appearance. Values are codes: merged before they are gathered."""
    first = df.groupBy(*by, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias(name))


def missing(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left rows without a right row: unregistered frames, frames without a mask, unknown names."""
    return join_same(left, right.select(*by), list(by), "left_anti")
