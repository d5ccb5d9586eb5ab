"""Joins between views, tracks, sources and components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import arrays, geometry as geo
from clipledger.operators.aggregates import quantiles
from clipledger.operators.groups import by_group, top_k
from clipledger.session import join_same, settle

# Edges of the view-pair angle bins in degrees.
ANGLE_EDGES = [0.0, 15.0, 35.0, 65.0, 100.0, 140.0, 180.000001]
SPREAD, HOT = 4, 1024  # parts of one side of the token join, for tokens that more views than this hold
SHORT = 16  # tokens of a list that goes along with each of them


def angle_bin(angle: Column) -> Column:
    """Number of the angle bin, counting from 0."""
    return sum(((angle >= e).cast("int") for e in ANGLE_EDGES[1:]), F.lit(0))


def bin_middle(bin_col: Column) -> Column:
    mids = F.array(*[F.lit((a + b) / 2) for a, b in zip(ANGLE_EDGES, ANGLE_EDGES[1:])])
    return mids[bin_col]


def view_pairs(views: DataFrame, tokens: DataFrame, by: Sequence[str], view: str, direction: str, token: str, min_angle: float = 8.0, min_shared: int = 3) -> DataFrame:
    """View pairs at least ``min_angle`` apart that share ``min_shared`` tokens, with their angle bin.

    Tokens of a group stand in one order, rarest first. A view with n tokens that shares ``min_shared`` with another
    shares one of its first n - min_shared + 1, so only those are joined (prefix filter), and from a common token on
    both sides must have enough left (positional filter); the commonest tokens never meet. Lists of up to ``SHORT``
    tokens go along and are compared where they meet, so that only pairs that share enough are passed on; pairs with a
    longer list travel as view ids alone. Directions and token lists join them once per pair, not once per token. A token that more than ``HOT``
    views hold is spread by splitting one side of the join into ``SPREAD`` parts and copying the other; all others, nearly all, go once.
    """
    by = list(by)
    tk = settle(tokens.select(*by, F.col(view).alias("_v"), F.col(token).alias("_t")).distinct())
    freq = tk.groupBy(*by, "_t").agg(F.count("*").alias("_f"))
    lists = join_same(tk, freq, by + ["_t"]).groupBy(*by, "_v").agg(F.array_sort(F.collect_list(F.struct("_f", "_t"))).alias("_l"))
    # rarest first: from some place on all are held by many
    lists = lists.select(*by, "_v", F.transform("_l", lambda s: s["_t"]).alias("_ts"), F.size(F.filter("_l", lambda s: s["_f"] <= HOT)).alias("_rare"))
    lists = settle(lists.where(F.size("_ts") >= min_shared))
    head = lists.select(*by, "_v", "_rare", F.size("_ts").alias("_n"), F.when(F.size("_ts") <= SHORT, F.col("_ts")).alias("_ts"), F.posexplode(F.slice("_ts", 1, F.size("_ts") - min_shared + 1)).alias("_i", "_t"))
    rare = F.col("_i") < F.col("_rare")
    one = head.withColumn("_s", F.when(rare, F.lit(0)).otherwise(F.pmod(F.xxhash64("_v"), F.lit(SPREAD))).cast("int"))
    two = head.withColumn("_s", F.explode(F.when(rare, F.array(F.lit(0))).otherwise(F.array(*[F.lit(i) for i in range(SPREAD)]))))
    one = one.select(*by, "_t", "_s", F.col("_v").alias("view_a"), (F.col("_n") - F.col("_i")).alias("_ra"), F.col("_ts").alias("_sa"))
    two = two.select(*by, "_t", "_s", F.col("_v").alias("view_b"), (F.col("_n") - F.col("_i")).alias("_rb"), F.col("_ts").alias("_sb"))
    unknown = F.col("_sa").isNull() | F.col("_sb").isNull()
    near = (F.col("view_a") < F.col("view_b")) & (F.least("_ra", "_rb") >= min_shared) & (unknown | (F.size(F.array_intersect("_sa", "_sb")) >= min_shared))
    cand = join_same(one, two, by + ["_t", "_s"]).where(near).select(*by, "view_a", "view_b").distinct()
    info = join_same(views.select(*by, F.col(view).alias("_v"), F.col(direction).alias("_d")), lists.drop("_rare"), by + ["_v"])
    for v, d, ts in (("view_a", "_da", "_ta"), ("view_b", "_db", "_tb")):
        cand = join_same(cand, info.withColumnsRenamed({"_v": v, "_d": d, "_ts": ts}), by + [v])
    out = cand.withColumn("angle", arrays.unit_angle3("_da", "_db")).withColumn("shared", F.size(F.array_intersect("_ta", "_tb")).cast("long"))
    out = out.where((F.col("angle") >= min_angle) & (F.col("shared") >= min_shared)).select(*by, "view_a", "view_b", "shared", "angle")
    return out.withColumn("angle_bin", angle_bin(F.col("angle")))


def loop_ranges(frames: DataFrame, by: Sequence[str], order: Sequence[str], name: str, overlap: int, stride: int) -> DataFrame:
    """Loop-closure partners of every ``stride``-th frame. Partners of an anchor are all anchors from some rank on, so
    each anchor yields one row with its first and last partner and their number instead of all pairs."""
    if stride < 1 or overlap < 0:
        raise ValueError("stride must be at least 1 and overlap at least 0")
    ahead = overlap // stride + 1

    def step(d, g):
        d = g.rank(d, order, "_i").where((F.col("_i") - 1) % stride == 0)
        d = g.slide(d, order, 0, ahead, first_partner=lambda w: F.lead(name, ahead).over(w))
        return g.attach(d, _last=F.max_by(name, F.col("_i")), _n=F.max("_i"))

    d = by_group(frames, by, step).where("first_partner IS NOT NULL")
    partners = F.floor((F.col("_n") - F.col("_i")) / stride) - ahead + 1
    return d.select(*by, F.col(name).alias("anchor"), "first_partner", F.col("_last").alias("last_partner"), partners.cast("long").alias("partners"))


def track_evidence(points: DataFrame, obs: DataFrame, views: DataFrame, by: Sequence[str], point: str, view: str, min_track: int = 3) -> DataFrame:
    """Observations of well-tracked points in retained views, with depth from each view's own pose (z > 0)."""
    by = list(by)
    p = points.where(F.col("track_length") >= min_track)
    d = join_same(join_same(obs, p, by + [point]), views.select(*by, view, "rotation", "translation"), by + [view])
    z = geo.to_camera(F.col("x"), F.col("y"), F.col("z"), F.col("rotation"), F.col("translation"))[2]
    return d.withColumn("z_camera", z).where(F.col("z_camera") > 0).drop("rotation", "translation")


def consensus(depths: DataFrame, cell: Sequence[str], source: str, depth: str, confidence: str, sources: int, tolerance: float = 0.055) -> DataFrame:
    """Value all sources agree on per cell, else 0; confidence is the lowest one. One row per (cell, source) on input."""
    d = depths.where(F.col(depth) > 0)
    stats = d.groupBy(*cell).agg(F.count_distinct(source).alias("_k"), F.min(depth).alias("_lo"), F.max(depth).alias("_hi"), F.min(confidence).alias("confidence"))
    j = join_same(stats, quantiles(d, cell, _med=(F.col(depth).cast("double"), 0.5)), list(cell))
    agree = (F.col("_k") == sources) & ((F.col("_hi") - F.col("_lo")) / F.col("_med") <= tolerance)
    out = j.withColumn("agreed", agree).withColumn("value", F.when(agree, F.col("_med")).otherwise(0.0))
    return out.withColumn("confidence", F.when(agree, F.col("confidence")).otherwise(0.0)).drop("_k", "_lo", "_hi", "_med")


def source_differences(depths: DataFrame, by: Sequence[str], cell: Sequence[str], source: str, depth: str) -> DataFrame:
    """Median symmetric relative difference of every two sources over their shared cells. A cell holds one row per
    source, and sources are few, so the equi-join on the cell stays linear in the cells."""
    by, cell = list(by), list(cell)
    d = depths.where(F.col(depth) > 0)
    a = d.select(*by, *cell, F.col(source).alias("a"), F.col(depth).alias("_x"))
    b = d.select(*by, *cell, F.col(source).alias("b"), F.col(depth).alias("_y"))
    j = join_same(a, b, by + cell).where("a < b").withColumn("_r", 2 * F.abs(F.col("_x") - F.col("_y")) / (F.col("_x") + F.col("_y")))
    n = j.groupBy(*by, "a", "b").agg(F.count("*").alias("overlap"))
    return join_same(n, quantiles(j, by + ["a", "b"], median_difference=(F.col("_r"), 0.5)), by + ["a", "b"])


def pair_by_priority(frames: DataFrame, assets: DataFrame, frame: str, asset: str, keys: Sequence[Column], strict: bool = False) -> DataFrame:
    """Match frames with assets by the first naming rule that exists. Unmatched frames are left out, or, if
    ``strict``, kept with a null asset for the caller's gate."""
    candidates = frames.select("*", F.posexplode(F.array(*keys)).alias("priority", "_key"))
    hits = candidates.join(assets.select(F.col(asset).alias("_key"), F.col(asset).alias("matched")).distinct(), "_key")
    best = top_k(hits, [frame], ["priority"], 1, "_rn").drop("_rn", "_key")
    if not strict:
        return best
    return join_same(frames, best.select(frame, "priority", "matched"), [frame], "left")
