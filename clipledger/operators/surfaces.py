"""Points, voxels, pixels and faces seen from views.

Points and voxels meet their views in ``fold``. Faces meet batches of views, which are unrolled and tested inside one
generated stage, so no pair is shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import geometry as geo
from clipledger.functions.rules import Rule, apply_gates
from clipledger.operators.aggregates import quantiles
from clipledger.operators.fold import CAMERA, dilate, fuse_views, support, votes
from clipledger.operators.groups import by_group, top_k
from clipledger.session import join_same, settle, spread_groups

VIEW_BATCH = 16
BROADCAST_BYTES = 64 << 20
SALTS = 32


def mask_bitmaps(pixels: DataFrame, by: Sequence[str], view: str) -> DataFrame:
    """Each view's mask as an array of 64-bit words, one bit per pixel. ``pixels`` holds y, x and the view's width.

    Words are formed by partial bit-ors, so a view gathers one value per 64 pixels of its image.
    """
    by = list(by)
    at = (F.col("y") * F.col("width") + F.col("x")).cast("long")
    words = pixels.select(*by, view, F.expr("width * height").alias("_n"), F.shiftright(at, 6).alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("_bit"))
    words = words.groupBy(*by, view, "_w").agg(F.bit_or("_bit").alias("_bits"), F.max("_n").alias("_n"))
    packed = words.groupBy(*by, view).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_m"), F.max("_n").alias("_n"))
    every = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("_n").cast("long") - 1, 6))
    return packed.select(*by, view, F.transform(every, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("mask"))


def _meet(points: DataFrame, views: DataFrame, by: list[str], view: str, fields: Sequence[str]) -> DataFrame:
    """Points with each view of their clip as ``_v``, unrolled inside the stage that consumes it.

    Views travel in batches, so points meet a batch once. Small batches are broadcast after their size is measured;
    larger ones are joined with points salted, so that a hot clip is spread over tasks.
    """
    v = by_group(views, by, lambda d, g: g.rank(d, [view], "_i")).withColumn("_b", F.expr(f"(_i - 1) div {VIEW_BATCH}"))
    batches = settle(v.groupBy(*by, "_b").agg(F.collect_list(F.struct(view, *fields)).alias("_vs"), F.sum(F.lit(256)).alias("_bytes")))
    size = batches.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    batches = batches.drop("_b", "_bytes")
    if size <= BROADCAST_BYTES:
        met = join_same(points, F.broadcast(batches), by)
    else:
        salted = points.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int"))
        copies = batches.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = join_same(salted, copies, by + ["_salt"]).drop("_salt")
    return met.withColumn("_v", F.explode("_vs")).drop("_vs")


def point_support(points: DataFrame, views: DataFrame, by: Sequence[str], point: str, view: str) -> DataFrame:
    """Number of views whose mask contains the projection of each point (x, y, z). Points without views have none."""
    return support(points, views, by, [point], view).select(*by, point, "support")


def carve(voxels: DataFrame, views: DataFrame, by: Sequence[str], voxel: Sequence[str], view: str, limit: int | Column = 0, outside: str = "abstain") -> DataFrame:
    """Voxels rejected by at most ``limit`` views. A view rejects a voxel that falls off its mask; off the image it
    abstains or rejects, as ``outside`` says. Adds ``rejections``. Where views abstain, the image ends at its exact
    border, and pixels are rounded within it; where they reject, positions are rounded first. For whole grids,
    :func:`fold.carve_grid` gives the same rows without a row per voxel ahead of the result."""
    if outside not in ("abstain", "reject"):
        raise ValueError("outside must be abstain or reject")
    known = limit if isinstance(limit, int) else None
    return votes(voxels, views, by, [*voxel, "x", "y", "z"], view, known, outside == "reject").where(F.col("rejections") <= limit)


def voxel_grid(clips: DataFrame, resolution: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Cell centres iz, iy, ix, x, y, z of a cubic grid for every clip row; planes are spread before cells are made."""
    step = (high - low) / (resolution - 1)
    axis = F.sequence(F.lit(0), F.lit(resolution - 1))
    d = spread_groups(clips.withColumn("iz", F.explode(axis)), [*clips.columns, "iz"]).withColumn("iy", F.explode(axis)).withColumn("ix", F.explode(axis))
    return d.withColumns({c: low + F.col(f"i{c}") * step for c in "xyz"})


def fuse_samples(samples: DataFrame, by: Sequence[str], measured: Column, depth: Column, confidence: Column, mu: float) -> DataFrame:
    """Weighted mean of clipped signed distances per cell; samples behind the surface by more than ``mu`` and
    unmeasured ones do not count."""
    sdf = (measured - depth) / mu
    use = (measured > 1e-6) & (depth > 1e-9) & (sdf >= -1)
    w = F.when(use, confidence / depth)
    return samples.groupBy(*by).agg(
        F.try_divide(F.sum(w * F.least(sdf, F.lit(1.0))), F.sum(w)).alias("tsdf"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"))


def fuse(voxels: DataFrame, views: DataFrame, by: Sequence[str], voxel: Sequence[str], view: str, mu: float, extent: float | None = None, edge_limit: float = 0.03) -> DataFrame:
    """Truncated signed distance per voxel from depth views, and its weight: flat ``depth_map`` (0 = none), and if there
    are such columns, ``conf_map`` and ``depth_conf``, a view's own confidence. A sample weighs their product over its
    depth. Samples behind the surface by more than ``mu`` do not count; with ``extent``, the object's size, neither do
    those where the depth image jumps by more than ``edge_limit`` of it. Voxels never seen have a null distance and no
    weight."""
    return fuse_views(voxels, views, by, voxel, view, mu, extent, edge_limit)


def fuse_grid(occupied: DataFrame, views: DataFrame, by: Sequence[str], view: str, resolution: int, low: float = -1.0, high: float = 1.0, trunc: float = 4.0, edge_limit: float = 0.03) -> DataFrame:
    """:func:`fuse` over the band of a grid: all cells within two steps of an occupied one (iz, iy, ix)."""
    by, step = list(by), (high - low) / (resolution - 1)
    band = dilate(occupied, by, resolution, 2).withColumns({c: low + F.col(f"i{c}") * step for c in "xyz"})
    return fuse(band, views, by, ["iz", "iy", "ix", "x", "y", "z"], view, trunc * step, 3**0.5 * (high - low), edge_limit)


def blend_fields(fused: DataFrame, hull: Column) -> DataFrame:
    """Mix a fused field with a hull field by the weight seen."""
    part = F.least(F.greatest(F.col("weight") / 1.5, F.lit(0.0)), F.lit(1.0))
    return fused.withColumn("field", F.coalesce(part * F.col("tsdf"), F.lit(0.0)) + (1 - part) * hull)


def project_faces(faces: DataFrame, views: DataFrame, by: Sequence[str], view: str) -> DataFrame:
    """Faces (p, q, r as arrays of three) in every view of their clip: pixel corners and depths, behind-camera and
    off-screen faces dropped before anything is exploded."""
    by = list(by)
    d = _meet(faces, views, by, view, CAMERA)
    v = F.col("_v")
    for n, c in enumerate("pqr"):
        p = geo.project(F.col(c)[0], F.col(c)[1], F.col(c)[2], v["rotation"], v["translation"], v["focal"], v["cx"], v["cy"], v["k1"])
        d = d.withColumn("_c", p).withColumns({f"u{n}": F.col("_c.u"), f"v{n}": F.col("_c.v"), f"z{n}": F.col("_c.z")}).drop("_c")
    d = d.withColumns({view: v[view], "width": v["width"], "height": v["height"]}).drop("_v")
    return d.where("z0 > 1e-9 AND z1 > 1e-9 AND z2 > 1e-9 AND greatest(u0, u1, u2) >= 0 AND greatest(v0, v1, v2) >= 0 AND least(u0, u1, u2) <= width - 1 AND least(v0, v1, v2) <= height - 1")


def zbuffer(projected: DataFrame, by: Sequence[str], face: str) -> DataFrame:
    """Nearest face and its depth per pixel of projected triangles (u0..z2, width, height).

    Rows of a triangle are exploded first and pixels second, within its bounds; depth is perspective-correct. The
    minimum is combined on the map side, so a busy pixel ships one candidate per task.
    """
    lo = lambda a, top: F.greatest(F.ceil(F.least(*[F.col(f"{a}{i}") for i in range(3)])), F.lit(0)).cast("int")
    hi = lambda a, top: F.least(F.floor(F.greatest(*[F.col(f"{a}{i}") for i in range(3)])), F.col(top) - 1).cast("int")
    d = projected.withColumns({"_y0": lo("v", "height"), "_y1": hi("v", "height"), "_x0": lo("u", "width"), "_x1": hi("u", "width")})
    area = (F.col("u1") - F.col("u0")) * (F.col("v2") - F.col("v0")) - (F.col("u2") - F.col("u0")) * (F.col("v1") - F.col("v0"))
    d = d.withColumn("_area", area).where("_y0 <= _y1 AND _x0 <= _x1 AND abs(_area) > 1e-12")
    d = d.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1")))

    def edge(i, j):
        return ((F.col(f"u{j}") - F.col(f"u{i}")) * (F.col("y") - F.col(f"v{i}")) - (F.col(f"v{j}") - F.col(f"v{i}")) * (F.col("x") - F.col(f"u{i}"))) / F.col("_area")

    d = d.withColumns({"_a": edge(1, 2), "_b": edge(2, 0), "_g": edge(0, 1)}).where("_a >= -1e-9 AND _b >= -1e-9 AND _g >= -1e-9")
    depth = 1 / (F.col("_a") / F.col("z0") + F.col("_b") / F.col("z1") + F.col("_g") / F.col("z2"))
    d = d.withColumn("depth", depth)
    return d.groupBy(*by, "y", "x").agg(F.min(F.struct(F.round("depth", 9).alias("depth"), face)).alias("_m")).select(*by, "y", "x", "_m.*")


def visible_faces(projected: DataFrame, nearest: DataFrame, by: Sequence[str], face: str, tolerance: float, frontality: Column, minimum: float = 0.0) -> DataFrame:
    """Faces whose centroid pixel is not hidden by a nearer surface and that face the view."""
    by = list(by)
    d = projected.withColumn("x", F.rint((F.col("u0") + F.col("u1") + F.col("u2")) / 3).cast("int")).withColumn("y", F.rint((F.col("v0") + F.col("v1") + F.col("v2")) / 3).cast("int"))
    d = d.withColumn("_z", (F.col("z0") + F.col("z1") + F.col("z2")) / 3).where(frontality > minimum)
    return join_same(d, nearest.select(*by, "y", "x", F.col("depth").alias("_near")), by + ["y", "x"]).where(F.col("_z") <= F.col("_near") + tolerance).select(*by, face)


def reproject_pairs(pairs: DataFrame, pixels: DataFrame, views: DataFrame, by: Sequence[str], tolerance: Column, scale: Column | None = None) -> DataFrame:
    """Both directions of every view pair: pixels of one view carried into the other and classified.

    ``pixels`` has view, y, x, depth (null or ≤ 0 = unavailable), stable and in_mask; ``pairs`` has view_a and view_b.
    The mask and stability of the nearest pixel decide, and the depth there is interpolated between the four pixels
    around (missing ones are 0). One row per pair with the counts of both directions and of each (``forward_`` and
    ``backward_``), ``consistency``, ``coverage`` and the median relative error of matches and near contradictions,
    over both directions and for each; and if the object's ``scale`` is given, their median error in it.
    """
    by = list(by)
    ways = pairs.select(*by, "view_a", "view_b", F.explode(F.array(F.struct(F.col("view_a").alias("src"), F.col("view_b").alias("dst"), F.lit("forward").alias("way")), F.struct(F.col("view_b").alias("src"), F.col("view_a").alias("dst"), F.lit("backward").alias("way")))).alias("_w")).select(*by, "view_a", "view_b", "_w.*")
    cam = views.select(*by, F.col("view"), F.struct(*CAMERA).alias("_cam"))
    ways = join_same(ways, cam.withColumnRenamed("view", "src").withColumnRenamed("_cam", "_s"), by + ["src"])
    ways = join_same(ways, cam.withColumnRenamed("view", "dst").withColumnRenamed("_cam", "_d"), by + ["dst"])
    good = pixels.where("depth > 1e-9 AND stable AND in_mask").select(*by, F.col("view").alias("src"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("depth").alias("_z"))
    j = join_same(good, ways, by + ["src"])
    s, t = F.col("_s"), F.col("_d")
    world = geo.backproject(F.col("_x"), F.col("_y"), F.col("_z"), s["rotation"], s["translation"], s["focal"], s["cx"], s["cy"], s["k1"])
    j = j.withColumn("_p", world)
    at = geo.project(F.col("_p.x"), F.col("_p.y"), F.col("_p.z"), t["rotation"], t["translation"], t["focal"], t["cx"], t["cy"], t["k1"])
    j = j.withColumn("_q", at)
    inside = (F.col("_q.z") > 1e-9) & (F.col("_q.u") >= 0) & (F.col("_q.v") >= 0) & (F.col("_q.u") < t["width"] - 1) & (F.col("_q.v") < t["height"] - 1)
    whole = lambda c: F.when(inside, F.floor(c)).cast("int")
    j = j.select(*by, "view_a", "view_b", "way", F.col("dst").alias("view"), whole(F.col("_q.v")).alias("y"), whole(F.col("_q.u")).alias("x"), inside.alias("_in"), F.col("_q.z").alias("_pz"), (F.col("_q.u") - F.floor("_q.u")).alias("_fu"), (F.col("_q.v") - F.floor("_q.v")).alias("_fv"), F.rint("_q.u").alias("_ru"), F.rint("_q.v").alias("_rv"))
    # each pixel is a corner of four squares; a square has what its four corners hold
    corner = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]))
    px = pixels.select(*by, "view", "y", "x", F.struct(F.greatest(F.coalesce(F.col("depth").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("d"), F.coalesce("stable", F.lit(False)).alias("s"), F.coalesce("in_mask", F.lit(False)).alias("m")).alias("_c"), corner.alias("_k"))
    px = px.select(*by, "view", (F.col("y") - F.col("_k.dy")).cast("int").alias("y"), (F.col("x") - F.col("_k.dx")).cast("int").alias("x"), (2 * F.col("_k.dy") + F.col("_k.dx")).alias("_n"), "_c")
    square = px.groupBy(*by, "view", "y", "x").agg(*[F.max(F.when(F.col("_n") == n, F.col("_c"))).alias(f"_c{n}") for n in range(4)])
    j = join_same(j, square, by + ["view", "y", "x"], "left")
    d = [F.coalesce(F.col(f"_c{n}.d"), F.lit(0.0)) for n in range(4)]
    top, bottom = (d[n] * (1 - F.col("_fu")) + d[n + 1] * F.col("_fu") for n in (0, 2))
    near = 2 * (F.col("_rv") - F.col("y")) + (F.col("_ru") - F.col("x"))
    flag = lambda f: F.coalesce(F.get(F.array(*[F.col(f"_c{n}.{f}") for n in range(4)]), near.cast("int")), F.lit(False))
    j = j.withColumns({"_t": top * (1 - F.col("_fv")) + bottom * F.col("_fv"), "_stable": flag("s"), "_mask": flag("m")})
    free = F.col("_pz") < F.col("_t") - tolerance
    kind = (
        F.when(~F.col("_in"), "outside").when(~F.col("_mask"), "contradiction").when(~F.col("_stable") | (F.col("_t") <= 1e-9), "unavailable")
        .when(free, "contradiction").when(F.col("_pz") > F.col("_t") + tolerance, "occluded").otherwise("match"))
    off = F.abs(F.col("_pz") - F.col("_t"))
    compared = (F.col("_kind") == "match") | ((F.col("_kind") == "contradiction") & F.col("_mask"))
    j = j.withColumn("_kind", kind).withColumn("_error", F.when(compared, off / F.greatest("_t", F.lit(1e-9))))
    if scale is not None:
        j = j.withColumn("_off", F.when(compared, off / scale))
    j = settle(j.select(*by, "view_a", "view_b", "way", "_kind", "_error", *(["_off"] if scale is not None else [])))
    n = lambda *ks, way=None: F.count(F.when(F.col("_kind").isin(*ks) & (F.lit(True) if way is None else F.col("way") == way), 1))
    kinds = {"matches": "match", "contradictions": "contradiction", "occluded": "occluded", "unavailable": "unavailable", "outside": "outside"}
    key = [*by, "view_a", "view_b"]
    out = j.groupBy(*key).agg(
        *[n(k).alias(name) for name, k in kinds.items()], *[n("match", "contradiction", way=w).alias(w) for w in ("forward", "backward")],
        *[n(k, way=w).alias(f"{w}_{name}") for w in ("forward", "backward") for name, k in kinds.items()], F.count("*").alias("pixels"))
    out = out.withColumn("consistency", F.try_divide("matches", F.col("matches") + F.col("contradictions"))).withColumn("coverage", F.try_divide(F.col("matches") + F.col("contradictions"), F.col("pixels")))
    medians = {"median_error": F.col("_error")} | {f"{w}_median_error": F.when(F.col("way") == w, F.col("_error")) for w in ("forward", "backward")} | ({} if scale is None else {"median_scaled_error": F.col("_off")})
    return join_same(out, quantiles(j, key, **{k: (c, 0.5) for k, c in medians.items()}), key, "left")


def bilinear(points: DataFrame, image: DataFrame, by: Sequence[str], point: str, width: int, height: int) -> DataFrame:
    """Bilinear sample of ``image`` (y, x, value) at float pixels (u, v), clamped to the image."""
    by = list(by)
    u = F.least(F.greatest(F.col("u"), F.lit(0.0)), F.lit(width - 1.000001))
    v = F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(height - 1.000001))
    d = points.withColumns({"_u": u, "_v": v}).withColumns({"_x": F.floor("_u"), "_y": F.floor("_v")}).withColumns({"_fu": F.col("_u") - F.col("_x"), "_fv": F.col("_v") - F.col("_y")})
    corner = lambda dy, dx, w: F.struct(F.least(F.col("_y") + dy, F.lit(height - 1)).alias("y"), F.least(F.col("_x") + dx, F.lit(width - 1)).alias("x"), w.alias("w"))
    fu, fv = F.col("_fu"), F.col("_fv")
    d = d.select(*by, point, F.explode(F.array(corner(0, 0, (1 - fu) * (1 - fv)), corner(0, 1, fu * (1 - fv)), corner(1, 0, (1 - fu) * fv), corner(1, 1, fu * fv))).alias("_c")).select(*by, point, "_c.*")
    return join_same(d, image.select(*by, "y", "x", "value"), by + ["y", "x"]).groupBy(*by, point).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def silhouette_stats(pixels: DataFrame, by: Sequence[str], width: Column, height: Column) -> DataFrame:
    """Shape statistics of masks given as their set pixels (y, x): area, border touch, width profile, radial spread
    and mirror symmetries. Flips are equi-joins on mirrored coordinates within the mask's bounds."""
    by = list(by)
    px = settle(pixels.select(*by, "y", "x", width.alias("_w"), height.alias("_h")).distinct())
    x, y = F.col("x"), F.col("y")
    edge = (x == 0).cast("int") + (x == F.col("_w") - 1).cast("int") + (y == 0).cast("int") + (y == F.col("_h") - 1).cast("int")
    base = px.groupBy(*by).agg(
        F.count("*").alias("_n"), F.max("_w").alias("_fw"), F.max("_h").alias("_fh"), F.sum(edge).alias("_edge"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    d = join_same(px, base, by)
    # a contour pixel misses at least one of its four neighbours
    beside = px.select(*by, F.explode(F.array(*[F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("_c")).select(*by, "_c.*")
    full = beside.groupBy(*by, "y", "x").agg(F.count("*").alias("_k")).where("_k = 4").drop("_k")
    rim = join_same(d, full, by + ["y", "x"], "left_anti").withColumn("_r", F.sqrt((x - F.col("_mx")) ** 2 + (y - F.col("_my")) ** 2))
    radial = rim.groupBy(*by).agg((F.stddev_pop("_r") / F.greatest(F.avg("_r"), F.lit(1e-9))).alias("radial_cv"))

    def mirrored(flip_x, flip_y):
        m = d.select(*by, (F.col("_x0") + F.col("_x1") - x if flip_x else x).alias("x"), (F.col("_y0") + F.col("_y1") - y if flip_y else y).alias("y"))
        return join_same(px.select(*by, "y", "x"), m, by + ["y", "x"], "left_semi").groupBy(*by).agg(F.count("*").alias("_i"))

    out = join_same(base, radial, by)
    for name, fx, fy in (("symmetry_lr", True, False), ("symmetry_tb", False, True), ("symmetry_180", True, True)):
        out = join_same(out, mirrored(fx, fy), by, "left").withColumn("_i", F.coalesce("_i", F.lit(0)))
        out = out.withColumn(name, F.col("_i") / (2 * F.col("_n") - F.col("_i"))).drop("_i")
    rows = px.groupBy(*by, "y").agg(F.count("*").alias("_c"))
    span = base.select(*by, "_y0", (F.col("_y1") - F.col("_y0") + 1).alias("_k"), F.explode(F.sequence("_y0", "_y1")).alias("y"))
    prof = join_same(span, rows, by + ["y"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)).cast("double")).withColumn("_p", F.col("y") - F.col("_y0"))
    k, p = F.col("_k"), F.col("_p")
    band = F.greatest(F.lit(1), F.rint(k * 0.20))
    m0 = F.rint(k * 0.40)
    m1 = F.greatest(m0 + 1, F.rint(k * 0.60))
    prof = prof.groupBy(*by).agg(
        F.avg(F.when(p < band, F.col("_c"))).alias("_top"), F.avg(F.when(p >= k - band, F.col("_c"))).alias("_bottom"), F.avg(F.when((p >= m0) & (p < m1), F.col("_c"))).alias("_mid"),
        (F.stddev_pop("_c") / F.greatest(F.avg("_c"), F.lit(1.0))).alias("profile_cv"))
    out = join_same(out, prof, by)
    cap = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.lit(top))
    return out.select(
        *by, (F.col("_n") / (F.col("_fw") * F.col("_fh"))).alias("area_fraction"), (F.col("_edge") / (2 * (F.col("_fw") + F.col("_fh")))).alias("border_touch"),
        cap(F.least("_top", "_bottom") / F.greatest(F.col("_mid"), F.lit(1.0)), 1.5).alias("end_ratio"),
        cap(F.abs(F.col("_top") - F.col("_bottom")) / F.greatest(F.col("_top"), F.col("_bottom"), F.lit(1.0)), 1.0).alias("end_asymmetry"),
        cap(F.col("profile_cv"), 2.0).alias("profile_cv"), cap(F.col("radial_cv"), 2.0).alias("radial_cv"), "symmetry_lr", "symmetry_tb", "symmetry_180")


def face_geometry(faces: DataFrame) -> DataFrame:
    """Area, centroid and unit normal of faces given as corner arrays p, q, r; plus the signed volume to the origin."""
    p, q, r = ([F.col(c)[i] for i in range(3)] for c in "pqr")
    n = geo.face_normal(p, q, r)
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = [F.coalesce(F.try_divide(c, size), F.lit(0.0)) for c in n]
    c = geo.cross(q, r)
    return faces.withColumns({
        "area": size / 2, "centroid": F.array(*[(p[i] + q[i] + r[i]) / 3 for i in range(3)]), "normal": F.array(*unit), "volume": (p[0] * c[0] + p[1] * c[1] + p[2] * c[2]) / 6})


def score_face_views(candidates: DataFrame, by: Sequence[str], face: str, view: str, *, visible: Column, area: Column, frontality: Column, inside: Column, boundary: Column,
                     in_mask: Column | None = None, min_frontality: float, min_boundary: float, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Gate candidate (face, view) rows and keep the best ``k`` views per face by area·boundary·frontality.

    ``inside`` and ``in_mask`` tell whether all corners lie in the image and in its mask (no mask: everywhere).
    Returns the kept rows and, per group, how many rows pass each gate by itself and all of them (``passed``).
    """
    by = list(by)
    gates = {"visible": visible, "frontal": frontality > min_frontality, "inside": inside, "in_mask": F.lit(True) if in_mask is None else in_mask, "clear_of_boundary": boundary > min_boundary}
    d, passed = candidates, F.lit(True)
    for n, c in gates.items():
        passed = passed & F.coalesce(c, F.lit(False))
        d = d.withColumn(f"_{n}", F.coalesce(c, F.lit(False)))
    d, gates = d.withColumn("_passed", passed), [*gates, "passed"]
    stats = d.groupBy(*by).agg(F.count("*").alias("candidates"), *[F.count(F.when(F.col(f"_{n}"), 1)).alias(n) for n in gates])
    quality = area * F.least(F.lit(1.0), boundary / (3 * min_boundary)) * frontality
    kept = d.where("_passed").withColumn("quality", quality).drop(*[f"_{n}" for n in gates])
    return top_k(kept, [*by, face], [F.col("quality").desc(), view], k, "slot"), stats


def best_source(samples: DataFrame, by: Sequence[str], view: str, *, facing: Column, boundary: Column, confidence: Column, sharpness: Column, preferred: Column, keep: Sequence[str],
                boundary_scale: float = 32.0, min_facing: float = 0.12, bonus: float = 0.22) -> DataFrame:
    """Strongest view per texel; the first view wins ties."""
    part = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    score = 0.45 * part(facing) + 0.22 * part(boundary / max(boundary_scale, 1.0)) + 0.16 * confidence + 0.17 * sharpness + F.when(preferred, bonus).otherwise(0.0)
    d = samples.where(facing >= min_facing).withColumn("score", F.round(score, 9)).withColumn("_s", -F.col("score"))
    return d.groupBy(*by).agg(F.min(F.struct("_s", view, "score", *keep)).alias("_b")).select(*by, f"_b.{view}", "_b.score", *[f"_b.{c}" for c in keep])


def weld(vertices: DataFrame, by: Sequence[str], vid: str, decimals: int = 8) -> DataFrame:
    """Map vertices to the lowest id at the same rounded position. Equal positions meet through partial minima."""
    by = list(by)
    v = vertices.select(*by, vid, *[F.round(c, decimals).alias(c) for c in "xyz"])
    first = v.groupBy(*by, "x", "y", "z").agg(F.min(vid).alias("welded"))
    return join_same(v, first, by + ["x", "y", "z"]).select(*by, vid, "welded")


def edge_counts(faces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges a < b of triangles (v0, v1, v2) with the number of faces on them."""
    e = lambda i, j: F.struct(F.least(f"v{i}", f"v{j}").alias("a"), F.greatest(f"v{i}", f"v{j}").alias("b"))
    return faces.select(*by, F.explode(F.array(e(0, 1), e(1, 2), e(2, 0))).alias("_e")).groupBy(*by, "_e.a", "_e.b").agg(F.count("*").alias("faces"))


def topology(faces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Vertices, edges, faces, boundary and non-manifold edges and Euler number per mesh."""
    by = list(by)
    e = edge_counts(faces, by)
    es = e.groupBy(*by).agg(F.count("*").alias("edges"), F.count(F.when(F.col("faces") == 1, 1)).alias("boundary_edges"), F.count(F.when(F.col("faces") > 2, 1)).alias("non_manifold_edges"))
    fs = faces.groupBy(*by).agg(F.count("*").alias("faces"))
    vs = faces.select(*by, F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct().groupBy(*by).agg(F.count("*").alias("vertices"))
    out = join_same(join_same(es, fs, by), vs, by)
    return out.withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def mesh_metrics(vertices: DataFrame, faces: DataFrame, by: Sequence[str], max_components: int = 1) -> DataFrame:
    """Topology after welding, components, surface area, volume and extents, judged by the delivery gate."""
    from clipledger.operators.graph import components

    by = list(by)
    w = settle(weld(vertices, by, "vid"))
    f = faces
    for c in ("v0", "v1", "v2"):
        f = join_same(f.drop("welded"), w.withColumnRenamed("vid", c), by + [c]).drop(c).withColumnRenamed("welded", c)
    f = settle(f.where("v0 != v1 AND v1 != v2 AND v0 != v2"))
    top = topology(f, by)
    node = lambda c: F.concat_ws("|", *[F.col(b).cast("string") for b in by], F.col(c).cast("string"))
    edges = edge_counts(f, by).select(*by, node("a").alias("src"), node("b").alias("dst"))
    comp = components(edges.select("src", "dst"))
    parts = edges.select(*by, F.col("src").alias("node")).distinct().join(comp, "node").groupBy(*by).agg(F.count_distinct("component").alias("components"))
    pos = vertices.select(*by, F.col("vid").alias("_v"), F.array("x", "y", "z").alias("_p"))
    g = f
    for c, n in (("v0", "p"), ("v1", "q"), ("v2", "r")):
        g = join_same(g, pos.withColumnRenamed("_v", c).withColumnRenamed("_p", n), by + [c])
    size = face_geometry(g).groupBy(*by).agg(F.sum("area").alias("area"), F.abs(F.sum("volume")).alias("volume"))
    box = vertices.groupBy(*by).agg(*[(F.max(c) - F.min(c)).alias(f"extent_{c}") for c in "xyz"])
    out = join_same(join_same(join_same(top, parts, by), size, by), box, by)
    extents = F.array_sort(F.array("extent_x", "extent_y", "extent_z"))
    out = out.withColumn("aspect", F.try_divide(extents[2], F.greatest(extents[0], F.lit(1e-12))))
    return apply_gates(out, [
        Rule("open_boundary", F.col("boundary_edges") > 0), Rule("non_manifold_edges", F.col("non_manifold_edges") > 0),
        Rule("too_many_components", F.col("components") > max_components), Rule("empty_volume", F.col("volume") <= 1e-12)])


def look_at(views: DataFrame, by: Sequence[str], centre: str, direction: str) -> DataFrame:
    """Point closest to all viewing axes: the sum of projectors I - d·dᵀ solved against the centres."""
    n = F.sqrt(sum((F.col(direction)[i] * F.col(direction)[i] for i in range(3)), F.lit(0.0)))
    d = views.select(*by, *[F.col(centre)[i].cast("double").alias(f"c{i}") for i in range(3)], *[(F.col(direction)[i] / n).cast("double").alias(f"d{i}") for i in range(3)])
    m = lambda i, j: (F.lit(1.0) if i == j else F.lit(0.0)) - F.col(f"d{i}") * F.col(f"d{j}")
    aggs = [F.sum(m(i, j)).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)]
    aggs += [F.sum(sum((m(i, j) * F.col(f"c{j}") for j in range(3)), F.lit(0.0))).alias(f"b{i}") for i in range(3)]
    s = d.groupBy(*by).agg(*aggs)
    a = [[F.col(f"m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]

    def det(r):
        return r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])

    whole = det(a)
    solved = [F.try_divide(det([[F.col(f"b{i}") if j == k else a[i][j] for j in range(3)] for i in range(3)]), whole).alias(n) for k, n in enumerate("xyz")]
    return s.select(*by, *solved)
