"""Connected regions of pixels, by runs of lines, and the nearest point of a plane.

A mask's pixels become runs of neighbours within a line. Two lines are compared as sorted intervals: of two runs that
touch, the one that begins later touches the last run of the other line that began before it. So every run brings two
links at most, and regions are components of runs, not of pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.operators.graph import components
from clipledger.session import join_same, settle

#: Levels by which the first cells of a search are finer than one point a cell.
FINER = 3


def pixel_runs(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs x0 to x1 of set pixels (y, x) in each line; repeated pixels count once. A window holds one line."""
    by = list(by)
    line = Window.partitionBy(*by, "y").orderBy("x")
    d = pixels.select(*by, "y", "x").withColumn("_k", F.col("x") - F.dense_rank().over(line))
    return d.groupBy(*by, "y", "_k").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_k")


def run_links(runs: DataFrame, by: Sequence[str], neighbours: int = 8) -> DataFrame:
    """Touching runs of neighbouring lines: ``upper`` and ``lower``, the beginnings of the runs of lines y and y + 1.
    Twice as many as runs at most. With 8 ``neighbours`` corners touch too, with 4 sides alone."""
    if neighbours not in (4, 8):
        raise ValueError("4 or 8 neighbours")
    by, slack = list(by), int(neighbours == 8)
    own = F.struct("x0", "x1")
    ways = F.explode(F.array(F.struct(F.col("y").alias("line"), F.lit(0).alias("side")), F.struct((F.col("y") - 1).alias("line"), F.lit(1).alias("side"))))
    d = runs.select(*by, "x0", "x1", ways.alias("_w")).select(*by, "x0", "x1", "_w.line", "_w.side")
    before = Window.partitionBy(*by, "line").orderBy("x0", "side").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.last(F.when(F.col("side") == side, own), ignorenulls=True).over(before)
    d = d.withColumn("_other", F.when(F.col("side") == 0, last(1)).otherwise(last(0))).where(F.col("x0") <= F.col("_other.x1") + slack)
    up = F.col("side") == 0
    pick = lambda a, b: F.when(up, a).otherwise(b)
    return d.select(*by, F.col("line").alias("y"), pick(F.col("x0"), F.col("_other.x0")).alias("upper"), pick(F.col("_other.x0"), F.col("x0")).alias("lower"))


def pixel_regions(pixels: DataFrame, by: Sequence[str], neighbours: int = 8) -> DataFrame:
    """Runs of all masks with their region: y, x0, x1, ``region_y`` and ``region_x``, the region's first pixel in the
    order of lines."""
    by = list(by)
    runs = settle(pixel_runs(pixels, by))
    node = lambda y, x: F.struct(*by, y.alias("y"), x.alias("x"))
    links = run_links(runs, by, neighbours).select(node(F.col("y"), F.col("upper")).alias("src"), node(F.col("y") + 1, F.col("lower")).alias("dst"))
    found = components(links).select("node", "component")
    out = runs.withColumn("node", node(F.col("y"), F.col("x0"))).join(found, "node", "left").withColumn("_r", F.coalesce("component", "node"))
    return out.select(*by, "y", "x0", "x1", F.col("_r.y").alias("region_y"), F.col("_r.x").alias("region_x"))


def region_stats(regions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each region's area and bounds, and for its mask the number of regions, the largest region's share of all pixels
    and whether this is the largest (ties: the first one)."""
    by = list(by)
    area = F.sum(F.col("x1") - F.col("x0") + 1)
    s = regions.groupBy(*by, "region_y", "region_x").agg(area.alias("area"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x0").alias("left"), F.max("x1").alias("right"))
    best = F.min(F.struct((-F.col("area")).alias("a"), "region_y", "region_x"))
    t = s.groupBy(*by).agg(F.count("*").alias("regions"), F.sum("area").alias("_all"), best.alias("_b"))
    out = join_same(s, t, by).withColumn("dominance", -F.col("_b.a") / F.col("_all"))
    return out.withColumn("largest", (F.col("region_y") == F.col("_b.region_y")) & (F.col("region_x") == F.col("_b.region_x"))).drop("_all", "_b")


def nearest_point(points: DataFrame, seeds: DataFrame, by: Sequence[str], seed: str, ties: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """For each seed (x, y) the nearest point (x, y) of its group, of equally near ones the first by ``ties``: the
    columns ``by``, ``seed``, ``ties``, ``keep`` and ``distance``. Seeds of groups without points are left out.

    Points lie in cells of a grid whose cells double from step to step. A seed looks at the nine cells around it and is
    done as soon as it finds a point nearer than a cell is wide, since all points outside are farther; so it meets few
    points where they lie close, and where they do not, large cells hold few.
    """
    by = list(by)
    inner = [*dict.fromkeys([*ties, *keep])]
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).cast("double")
    size = points.groupBy(*by).agg((F.when(span > 0, span).otherwise(1.0) / F.sqrt(F.count("*")) / 2**FINER).alias("_size"))
    size = settle(size)
    p = settle(join_same(points.select(*by, *inner, *[F.col(c).cast("double").alias(f"_{c}") for c in "xy"]), size, by))
    left = settle(join_same(seeds.select(*by, seed, *[F.col(c).cast("double").alias(f"_s{c}") for c in "xy"]), size, by))
    done, level = None, 0
    cell = lambda c, wide: F.floor(F.col(c) / wide)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        wide = F.col("_size") * float(2**level)
        own = p.withColumns({"_i": cell("_x", wide), "_j": cell("_y", wide)})
        near = left.withColumn("_c", F.explode(around)).withColumns({"_i": cell("_sx", wide) + F.col("_c.i"), "_j": cell("_sy", wide) + F.col("_c.j")}).drop("_c", "_size")
        met = join_same(near, own, [*by, "_i", "_j"])
        dx, dy = F.col("_x") - F.col("_sx"), F.col("_y") - F.col("_sy")
        met = met.withColumn("_d", F.sqrt(dx * dx + dy * dy)).where(F.col("_d") < wide)
        found = settle(met.groupBy(*by, seed).agg(F.min(F.struct("_d", *inner)).alias("_b")))
        done = found if done is None else done.unionByName(found)
        left = settle(join_same(left, found.select(*by, seed), [*by, seed], "left_anti"))
        if left.isEmpty():
            return done.select(*by, seed, *[F.col(f"_b.{c}").alias(c) for c in inner], F.col("_b._d").alias("distance"))
        level += 1


def region_of_seed(regions: DataFrame, seeds: DataFrame, by: Sequence[str], seed: str) -> DataFrame:
    """The region of each seed pixel (y, x): the one it lies in, or that of the nearest pixel, of equally near ones the
    first in the order of lines. Seeds of empty masks are left out."""
    by = list(by)
    s = seeds.select(*by, seed, "y", "x")
    inside = join_same(s, regions, [*by, "y"]).where("x BETWEEN x0 AND x1")
    hit = settle(inside.select(*by, seed, "region_y", "region_x", F.lit(0.0).alias("distance")))
    rest = join_same(s, hit.select(*by, seed), [*by, seed], "left_anti")
    pixels = join_same(regions, rest.select(*by).distinct(), by, "left_semi").select(*by, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "region_y", "region_x")
    far = nearest_point(pixels, rest, by, seed, ["y", "x"], ["region_y", "region_x"])
    return hit.unionByName(far.select(*hit.columns))
