"""Grouped, robust and weighted aggregates. ``by`` names the clip columns; ``[]`` means the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.functions import geometry as geo
from clipledger.functions.rules import Rule, apply_gates
from clipledger.functions.scoring import clip, unit
from clipledger.operators.groups import by_group, top_k, weighted_quantile
from clipledger.session import join_same

# Grey levels that count as crushed or blown out.
DARK_LEVEL, CLIPPED_LEVEL = 12, 245


def quantiles(df: DataFrame, by: Sequence[str], **cols: tuple[Column, float]) -> DataFrame:
    """One row per group with exact linear quantiles."""
    return by_group(df, by, lambda d, g: g.quantiles(d, **cols))


def entropy(df: DataFrame, by: Sequence[str], bin_cols: Sequence[str], name: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of the value counts per group; counting first keeps the shuffle small."""
    n = df.groupBy(*by, *bin_cols).agg(F.count("*").alias("_n"))
    # -Σ p·log2 p with p = n/N equals log2 N - Σ n·log2 n / N, so one pass over the counts is enough
    return n.groupBy(*by).agg(
        F.greatest(F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n"), F.lit(0.0)).alias(name)
    )


def frame_metrics(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brightness, contrast, entropy, Laplacian variance, dark and clipped fraction per frame.

    ``pixels`` holds y, x, b, g, r. Neighbours come from windows along one image row or column, which are
    bounded by the image size; the border mirrors the inner neighbour.
    """
    grey = F.rint(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r"))
    d = pixels.withColumn("grey", grey)
    row = Window.partitionBy(*by, "y").orderBy("x")
    column = Window.partitionBy(*by, "x").orderBy("y")

    def both(w):
        a, b = F.lag("grey").over(w), F.lead("grey").over(w)
        return F.coalesce(a, b, F.col("grey")) + F.coalesce(b, a, F.col("grey"))

    d = d.withColumn("_h", both(row)).withColumn("lap", F.col("_h") + both(column) - 4 * F.col("grey"))
    stats = d.groupBy(*by).agg(
        (F.avg("grey") / 255).alias("brightness_mean"),
        (F.stddev_pop("grey") / 255).alias("contrast_stddev"),
        F.var_pop("lap").alias("sharpness_laplacian"),
        F.avg((F.col("grey") <= DARK_LEVEL).cast("double")).alias("dark_fraction"),
        F.avg((F.col("grey") >= CLIPPED_LEVEL).cast("double")).alias("clipped_fraction"),
    )
    return join_same(stats, entropy(pixels.withColumn("grey", grey), by, ["grey"], "entropy_bits"), list(by))


def region_coverage(df: DataFrame, by: Sequence[str], hit: Column, central: Column, border: Column) -> DataFrame:
    """Share of hits overall, inside the central region, and on the border. ``border`` counts how many
    border strips hold the cell (corners lie on two)."""
    h = hit.cast("double")
    return df.groupBy(*by).agg(
        F.avg(h).alias("coverage"),
        F.coalesce(F.avg(F.when(central, h)), F.avg(h)).alias("central_coverage"),
        F.coalesce(F.sum(h * border) / F.sum(border), F.lit(0.0)).alias("border_touch"),
    )


def mask_coverage(pixels: DataFrame, by: Sequence[str], width: Column, height: Column, roi: float = 0.70) -> DataFrame:
    """:func:`region_coverage` of a dense mask (y, x, hit) with the usual margins and border strips."""
    mx, my = F.rint(width * (1 - roi) / 2), F.rint(height * (1 - roi) / 2)
    strip = F.greatest(F.lit(1), F.rint(F.least(width, height) * 0.02))
    x, y = F.col("x"), F.col("y")
    central = (x >= mx) & (x < width - mx) & (y >= my) & (y < height - my)
    tests = [y < strip, y >= height - strip, x < strip, x >= width - strip]
    border = sum((t.cast("int") for t in tests), F.lit(0))
    return region_coverage(pixels, by, F.col("hit") > 0, central, border)


def temporal_change(df: DataFrame, clip: Sequence[str], frame: str, cell: Sequence[str], value: str | Sequence[str], weights: Sequence[float] = (1.0,)) -> DataFrame:
    """Cells that differ from the temporal background, the per-cell median over all frames of the clip. The distance is
    Euclidean over the channels of ``value`` (one or several), each squared and weighted; for colours in Lab, weights of
    0.5, 1, 1 keep changes of light from dominating. The threshold per frame is median + 2.25·MAD, at least 10."""
    clip, cell = list(clip), list(cell)
    channels = [value] if isinstance(value, str) else list(value)
    if len(channels) != len(weights):
        raise ValueError("one weight for each channel")
    names = {c: "background" if len(channels) == 1 else f"background_{c}" for c in channels}
    ground = quantiles(df, clip + cell, **{names[c]: (F.col(c).cast("double"), 0.5) for c in channels})
    away = [F.lit(float(w)) * (F.col(c) - F.col(names[c])) ** 2 for c, w in zip(channels, weights)]
    distance = F.sqrt(sum(away[1:], away[0]))
    d = join_same(df, ground, clip + cell).withColumn("distance", distance)

    def threshold(d, g):
        d = g.attach_quantiles(d, _med=(F.col("distance"), 0.5))
        d = g.attach_quantiles(d, _mad=(F.abs(F.col("distance") - F.col("_med")), 0.5))
        limit = F.greatest(F.lit(10.0), F.col("_med") + 2.25 * F.greatest(F.col("_mad"), F.lit(1.0)))
        return d.withColumn("threshold", limit).withColumn("changed", F.col("distance") >= limit).drop("_med", "_mad")

    return by_group(d, clip + [frame], threshold)


def robust_unit(df: DataFrame, by: Sequence[str], neutral: float = 0.5, **cols: Column) -> DataFrame:
    """Add columns scaled so that the group's 10th percentile is 0 and its 90th is 1."""

    def step(d, g):
        qs = {f"_lo_{n}": (c, 0.1) for n, c in cols.items()} | {f"_hi_{n}": (c, 0.9) for n, c in cols.items()}
        d = g.attach_quantiles(d, **qs)
        d = d.select("*", *[unit(c, F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), neutral).alias(n) for n, c in cols.items()])
        return d.drop(*qs)

    return by_group(df, by, step)


def set_overlap(members: DataFrame, by: Sequence[str], item: Sequence[str], in_a: Column, in_b: Column) -> DataFrame:
    """IoU, precision and recall of two sets given as flagged rows; one row per (by, item) is formed first."""
    m = members.groupBy(*by, *item).agg(F.max(in_a.cast("int")).alias("_a"), F.max(in_b.cast("int")).alias("_b"))
    return m.groupBy(*by).agg(
        F.sum(F.col("_a") * F.col("_b")).alias("intersection"),
        F.sum(F.greatest("_a", "_b")).alias("union"),
        F.sum("_a").alias("size_a"),
        F.sum("_b").alias("size_b"),
    ).select(
        *by, "intersection", "union", "size_a", "size_b",
        F.coalesce(F.try_divide("intersection", "union"), F.lit(0.0)).alias("iou"),
        F.try_divide("intersection", "size_a").alias("precision"),
        F.try_divide("intersection", "size_b").alias("recall"),
    )


def support_fraction(df: DataFrame, by: Sequence[str], area: Column, support: Column) -> DataFrame:
    """Area share seen by at least one and at least two views."""
    total = F.sum(area)
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(support >= 1, area).otherwise(0.0)), total).alias("observed"),
        F.try_divide(F.sum(F.when(support >= 2, area).otherwise(0.0)), total).alias("multi_view"),
    )


def dispersion(samples: DataFrame, by: Sequence[str], item: Sequence[str], channels: Sequence[str], weight: str) -> DataFrame:
    """Weighted median over items of the cross-source RMS spread of their channels."""
    spread = sum((F.var_pop(c) for c in channels), F.lit(0.0)) / len(channels)
    per = samples.groupBy(*by, *item).agg(F.sqrt(F.greatest(spread, F.lit(0.0))).alias("rms"), F.max(weight).alias("_w"))
    return weighted_quantile(per, list(by), F.col("rms"), F.col("_w"), 0.5, "dispersion")


def robust_scale(df: DataFrame, by: Sequence[str], value: Column, floor: float = 1e-9) -> DataFrame:
    """Median and 1.4826·MAD per group."""

    def step(d, g):
        d = g.attach_quantiles(d.withColumn("_v", value.cast("double")), _med=(F.col("_v"), 0.5))
        return g.quantiles(d, median=(F.col("_v"), 0.5), mad=(F.abs(F.col("_v") - F.col("_med")), 0.5))

    return by_group(df, by, step).withColumn("scale", F.greatest(1.4826 * F.col("mad"), F.lit(floor)))


def circular_coverage(df: DataFrame, by: Sequence[str], angle: Column, elevation: Column, minimum: int = 2) -> DataFrame:
    """Span of a circle (360° less the largest gap), occupied 30° bins, elevation span and the widest pair.

    The partner farthest from an angle is the one nearest to its opposite point, so the widest pair comes
    from a sorted look-up and no pairs are formed.
    """
    by = list(by)
    full = df.select(*by, F.pmod(angle.cast("double"), F.lit(360.0)).alias("a"), elevation.cast("double").alias("e"))
    full = full.where("a IS NOT NULL")
    base = full.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.floor(F.col("a") / 30)).alias("bins"),
        (F.max("e") - F.min("e")).alias("elevation_span"),
    )
    points = full.select(*by, "a").distinct()

    def gaps(d, g):
        d = g.slide(d, ["a"], 0, 1, _next=lambda w: F.lead("a").over(w))
        return d.groupBy(*g.by).agg(
            F.max(F.col("_next") - F.col("a")).alias("_inner"), (360 - F.max("a") + F.min("a")).alias("_wrap")
        )

    def widest(d, g):
        # copies at a-360, a, a+360 serve as neighbours; probes sit at the opposite points
        copies = d.select(*g.by, F.explode(F.array(F.col("a") - 360, F.col("a"), F.col("a") + 360)).alias("p"))
        copies = copies.withColumn("t", F.col("p")).withColumn("o", F.lit(None).cast("double"))
        probes = d.select(*g.by, F.pmod(F.col("a") + 180, F.lit(360.0)).alias("p"))
        probes = probes.withColumn("t", F.lit(None).cast("double")).withColumn("o", F.col("p"))
        u = g.carry(copies.unionByName(probes), ["p", F.col("o").asc_nulls_first()], _below=F.col("t"))
        u = g.carry(u, [F.col("p").desc(), F.col("o").asc_nulls_first()], _above=F.col("t"))
        near = F.least(F.col("o") - F.col("_below"), F.col("_above") - F.col("o"))
        return u.where("o IS NOT NULL").groupBy(*g.by).agg((180 - F.min(near)).alias("max_pair_angle"))

    gap = by_group(points, by, gaps)
    wide = by_group(points, by, widest)
    out = join_same(join_same(base, gap, by, "left"), wide, by, "left")
    span = 360 - F.greatest(F.col("_inner"), F.col("_wrap"))
    return out.withColumn("span", F.when(F.col("rows") < minimum, 0.0).otherwise(span)).drop("_inner", "_wrap")


def pca3(points: DataFrame, by: Sequence[str], x: Column, y: Column, z: Column, centred: bool = True) -> DataFrame:
    """Eigenvalues of the 3x3 second moment, largest first, and the second/first ratio."""
    v = [x.cast("double"), y.cast("double"), z.cast("double")]
    if centred:
        m = [F.var_pop(v[0]), F.var_pop(v[1]), F.var_pop(v[2]), F.covar_pop(v[0], v[1]), F.covar_pop(v[0], v[2]), F.covar_pop(v[1], v[2])]
    else:
        m = [F.avg(v[0] * v[0]), F.avg(v[1] * v[1]), F.avg(v[2] * v[2]), F.avg(v[0] * v[1]), F.avg(v[0] * v[2]), F.avg(v[1] * v[2])]
    d = points.groupBy(*by).agg(*[c.alias(f"_m{i}") for i, c in enumerate(m)])
    e = geo.symmetric_eigenvalues([F.col(f"_m{i}") for i in range(6)])
    d = d.select("*", *[c.alias(f"eigen_{i + 1}") for i, c in enumerate(e)])
    return d.withColumn("second_ratio", F.coalesce(F.try_divide(F.greatest("eigen_2", F.lit(0.0)), "eigen_1"), F.lit(0.0)))


def pose_metrics(views: DataFrame, by: Sequence[str], radius: Column, look: Column, source: Column, inferred: Sequence[str], total: Column) -> DataFrame:
    """Radius median and spread, median look-at cosine, counts by source, independent count and share."""
    views = views.select("*", radius.alias("_r"), look.alias("_l"), source.alias("_s"))
    plain = views.groupBy(*by).agg(
        F.count("*").alias("views"),
        F.count(F.when(~F.col("_s").isin(*inferred), 1)).alias("independent_views"),
        (F.stddev_pop("_r") / F.greatest(F.avg("_r"), F.lit(1e-12))).alias("radius_cv"),
        F.max(total).alias("_total"),
    )
    robust = quantiles(views, by, radius_median=(F.col("_r"), 0.5), look_median=(F.col("_l"), 0.5))
    counts = views.groupBy(*by, "_s").agg(F.count("*").alias("_n")).groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_s", "_n")))).alias("source_counts")
    )
    out = join_same(join_same(plain, robust, list(by)), counts, list(by))
    return out.withColumn("registered_fraction", F.try_divide("independent_views", "_total")).drop("_total")


def robust_extent(points: DataFrame, by: Sequence[str], axes: dict[str, Column], low=0.05, high=0.95, minimum=12, pad=0.0) -> DataFrame:
    """Percentile box per group with its diagonal; too few points or no extent give a null scale and a reason."""
    axes = {n: c.cast("double") for n, c in axes.items()}
    qs = {f"{n}_low": (c, low) for n, c in axes.items()} | {f"{n}_high": (c, high) for n, c in axes.items()}
    box = join_same(quantiles(points, by, **qs), points.groupBy(*by).agg(F.count("*").alias("points")), list(by))
    diagonal = F.sqrt(sum(((F.col(f"{n}_high") - F.col(f"{n}_low")) ** 2 for n in axes), F.lit(0.0)))
    box = box.withColumn("_d", diagonal)
    few, flat = F.col("points") < minimum, F.col("_d") <= 1e-9
    box = box.withColumn("scale", F.when(few | flat, F.lit(None)).otherwise(F.col("_d")))
    box = box.withColumn("reason", F.when(few, "insufficient_points").when(flat, "degenerate_scale"))
    if pad:
        for n in axes:
            margin = (F.col(f"{n}_high") - F.col(f"{n}_low")) * pad
            box = box.withColumn(f"_p_{n}", margin)
            box = box.withColumn(f"{n}_low", F.col(f"{n}_low") - F.col(f"_p_{n}")).withColumn(f"{n}_high", F.col(f"{n}_high") + F.col(f"_p_{n}"))
            box = box.drop(f"_p_{n}")
    return box.drop("_d")


def drop_outlier_shell(points: DataFrame, by: Sequence[str], axes: dict[str, Column], track: Column, minimum_track=3, factor=3.0) -> DataFrame:
    """Keep well-tracked points within ``factor``·p75 of the per-axis median centre."""
    kept = points.where(track >= minimum_track)

    def step(d, g):
        d = g.attach_quantiles(d, **{f"_c_{n}": (c.cast("double"), 0.5) for n, c in axes.items()})
        r = F.sqrt(sum(((c - F.col(f"_c_{n}")) ** 2 for n, c in axes.items()), F.lit(0.0)))
        d = g.attach_quantiles(d.withColumn("radius", r), _p75=(F.col("radius"), 0.75))
        d = d.where(F.col("radius") <= factor * F.greatest(F.col("_p75"), F.lit(1e-9)))
        return d.drop("_p75", *[f"_c_{n}" for n in axes])

    return by_group(kept, by, step)


def error_summary(df: DataFrame, by: Sequence[str], aligned: Column, target: Column, scale: Column) -> DataFrame:
    """Scale-normalised median, p90 and RMS error; null when the scale is unusable."""
    good = (target > 1e-9) & aligned.isNotNull() & (scale > 1e-9)
    d = df.select("*", F.when(good, F.abs(aligned - target) / scale).alias("_e"), F.when(good, F.abs(aligned - target)).alias("_abs"))
    robust = quantiles(d, by, median=(F.col("_e"), 0.5), p90=(F.col("_e"), 0.9), absolute_median=(F.col("_abs"), 0.5))
    plain = d.groupBy(*by).agg(F.count("_e").alias("count"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rms"))
    return join_same(robust, plain, list(by))


def aggregate_hints(evidence: DataFrame, by: Sequence[str], frame: str, kind: str, confidence: str, frames: DataFrame,
                    min_score=0.30, min_frames=2, min_fraction=0.15, min_margin=0.08) -> DataFrame:
    """Score = mean confidence · √(share of frames with the kind); accept a clear, well supported winner.

    ``evidence`` has at most one row per (frame, kind); ``frames`` has one row per group with ``n_frames``.
    """
    by = list(by)
    per = evidence.groupBy(*by, kind).agg(F.count("*").alias("support_frames"), F.avg(confidence).alias("_mean"))
    return decide(per, by, kind, frames, min_score, min_frames, min_fraction, min_margin)


def decide(per: DataFrame, by: Sequence[str], kind: str, frames: DataFrame, min_score=0.30, min_frames=2, min_fraction=0.15, min_margin=0.08) -> DataFrame:
    """Winner per group from rows per kind (``support_frames``, ``_mean`` confidence); ``frames`` has ``n_frames``."""
    by = list(by)
    per = join_same(per, frames, by).withColumn("support_fraction", F.col("support_frames") / F.col("n_frames"))
    # 12 places: the mean's last digits depend on the order of rows, and equal scores go by kind
    per = per.withColumn("score", F.round(F.col("_mean") * F.sqrt("support_fraction"), 12))
    best = top_k(per, by, [F.col("score").desc(), F.col(kind)], 2, "_rn")
    first = F.col("_rn") == 1
    out = best.groupBy(*by).agg(
        F.max(F.when(first, F.col(kind))).alias("hint"),
        F.max(F.when(first, F.col("score"))).alias("score"),
        F.max(F.when(first, F.col("support_frames"))).alias("support_frames"),
        F.max(F.when(first, F.col("support_fraction"))).alias("support_fraction"),
        F.max(F.when(~first, F.col(kind))).alias("runner_up"),
        F.coalesce(F.max(F.when(~first, F.col("score"))), F.lit(0.0)).alias("_second"),
    )
    out = join_same(frames.select(*by), out, by, "left").withColumn("margin", F.round(F.col("score") - F.col("_second"), 12))
    return apply_gates(out, [
        Rule("no_mapped_evidence", F.col("hint").isNull()),
        Rule("score_too_low", F.col("score") < min_score),
        Rule("too_few_support_frames", F.col("support_frames") < min_frames),
        Rule("support_fraction_too_low", F.col("support_fraction") < min_fraction),
        Rule("margin_too_small", F.col("margin") < min_margin),
    ]).drop("_second", "details", "warnings")


def persistence_vote(frames: DataFrame, by: Sequence[str], green: Column, pink: Column, accepted: Column) -> DataFrame:
    """Clip-level class from per-frame evidence flags, green before pink before generic."""
    d = frames.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(green, 1)).alias("green"), F.count(F.when(pink, 1)).alias("pink"),
        F.count(F.when(accepted, 1)).alias("accepted_frames"),
    )
    is_green = F.col("green") >= F.greatest(F.lit(3), F.ceil(0.45 * F.col("n")))
    is_pink = ~is_green & (F.col("pink") >= F.greatest(F.lit(4), F.ceil(0.5 * F.col("n"))))
    d = d.withColumn("route", F.when(is_green, "green").when(is_pink, "pink").otherwise("generic"))
    persistent = F.col("route") != "generic"
    use = (persistent & (F.col("accepted_frames") >= 6)) | (F.col("accepted_frames") / F.col("n") >= 0.55)
    return d.withColumn("use_anchor", use)


def hist_distance(df: DataFrame, by: Sequence[str], frame: str, bin_col: str, weight: Column | None = None) -> DataFrame:
    """Bhattacharyya distance between each frame's histogram and the next one's.

    Frames are numbered once on the small (by, frame) table; each histogram is then matched with its
    successor by an equi-join on (number + 1, bin).
    """
    by = list(by)
    w = F.count("*") if weight is None else F.sum(weight)
    h = df.groupBy(*by, frame, bin_col).agg(w.cast("double").alias("_v"))
    totals = h.groupBy(*by, frame).agg(F.sum("_v").alias("_t"))
    totals = by_group(totals, by, lambda d, g: g.slide(d, [frame], 0, 1, next_frame=lambda w: F.lead(frame).over(w), _tn=lambda w: F.lead("_t").over(w)))
    totals = totals.where("next_frame IS NOT NULL")
    left = join_same(h, totals.select(*by, frame, "next_frame"), by + [frame])
    right = h.select(*by, F.col(frame).alias("next_frame"), bin_col, F.col("_v").alias("_w"))
    cross = join_same(left, right, by + ["next_frame", bin_col]).groupBy(*by, frame).agg(F.sum(F.sqrt(F.col("_v") * F.col("_w"))).alias("_bc"))
    out = join_same(totals, cross, by + [frame], "left")
    affinity = F.coalesce(F.col("_bc"), F.lit(0.0)) / F.sqrt(F.col("_t") * F.col("_tn"))
    return out.select(*by, frame, "next_frame", F.sqrt(F.greatest(F.lit(0.0), 1 - affinity)).alias("distance"))


def clip_features(frames: DataFrame, by: Sequence[str], features: Sequence[str], aspect: str, rounded: Column, quality: str,
                  order: Sequence[str], qs=(0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles of frame features over de-duplicated views, with derived view-coverage measures."""
    by = list(by)
    valid = frames.where(F.col(quality) >= 0.20).withColumn("_rounded", rounded)
    reps = best_per_bin(valid, by, F.rint(F.col(aspect) / 0.05), [F.col(quality).desc(), *order])
    cols = {f"{f}_q{round(q * 100):02d}": (F.col(f).cast("double"), q) for f in features for q in qs}
    cols |= {"_a10": (F.col(aspect).cast("double"), 0.1), "_a90": (F.col(aspect).cast("double"), 0.9)}
    q = quantiles(reps, by, **cols)
    d = join_same(reps.select(*by, F.col(aspect).alias("_a"), "_rounded"), q.select(*by, "_a10", "_a90"), by)
    face = F.col("_a") >= F.greatest(F.lit(0.12), 0.85 * F.col("_a90"))
    edge = F.col("_a") <= F.least(F.lit(0.60), F.greatest(F.lit(0.04), 1.3 * F.col("_a10")))
    derived = d.groupBy(*by).agg(
        F.count("*").alias("view_clusters"),
        F.count(F.when(face, 1)).alias("face_views"),
        F.count(F.when(edge, 1)).alias("edge_views"),
        F.avg(face.cast("double")).alias("face_fraction"),
        F.avg(edge.cast("double")).alias("edge_fraction"),
        F.avg((face & F.col("_rounded")).cast("double")).alias("rounded_face_fraction"),
        (F.min("_a") / F.greatest(F.max("_a"), F.lit(1e-6))).alias("edge_face_ratio"),
    )
    median = quantiles(valid, by, median_quality=(F.col(quality).cast("double"), 0.5))
    out = join_same(join_same(q, derived, by), median, by)
    spread = (F.col("_a90") - F.col("_a10")) / F.greatest(F.col("_a90"), F.lit(1e-6))
    return out.withColumn("aspect_view_range", spread).drop("_a10", "_a90")


def clip_evidence(frames: DataFrame, by: Sequence[str], quality: str, border: Column, holes: Column, dominance: Column) -> DataFrame:
    """What the route gate asks about a clip's masks beyond its features: how many there are and are usable, the share
    that touches the border, the largest hole fraction and the smallest share of the main component."""
    return frames.groupBy(*by).agg(
        F.count("*").alias("input_masks"), F.count(F.when(F.col(quality) >= 0.20, 1)).alias("valid_masks"), F.round(F.avg((border > 0.01).cast("double")), 4).alias("clipped_fraction"),
        F.round(F.max(holes), 4).alias("maximum_hole_fraction"), F.round(F.min(dominance), 4).alias("minimum_dominance"))


def best_per_bin(df: DataFrame, by: Sequence[str], bin_expr: Column, order: Sequence) -> DataFrame:
    """Best row per value bin; the group limit is planned before the shuffle."""
    return top_k(df.withColumn("view_bin", bin_expr.cast("long")), [*by, "view_bin"], order, 1, "_rn").drop("_rn")


def dense_band(df: DataFrame, by: Sequence[str], ratio: str, weight: Column, width=0.10, share=0.30) -> DataFrame:
    """Densest supported band of ratios: windows ``[r, r+width]`` holding enough rows compete by weight, then
    median; otherwise the 70th percentile is the centre.

    Equal ratios are merged first, so each group is a sorted list of distinct ratios with counts. A window
    spans two running sums, found by merging the end points into the same order: no range frame is buffered.
    """
    by = list(by)
    r = df.select(*by, F.col(ratio).cast("double").alias("r"), weight.cast("double").alias("w")).where("r IS NOT NULL")
    merged = r.groupBy(*by, "r").agg(F.count("*").alias("c"), F.sum("w").alias("w"))

    def windows(d, g):
        d = g.running(d, ["r"], _c=F.col("c"), _w=F.col("w"))
        ends = d.select(*g.by, (F.col("r") + width).alias("_at"), F.col("r").alias("start"), (F.col("_c") - F.col("c")).alias("_c0"), (F.col("_w") - F.col("w")).alias("_w0"))
        marks = d.select(*g.by, F.col("r").alias("_at"), F.col("_c").alias("_c1"), F.col("_w").alias("_w1"))
        u = marks.unionByName(ends, allowMissingColumns=True)
        u = g.carry(u, ["_at", F.col("start").asc_nulls_first()], _ce=F.col("_c1"), _we=F.col("_w1"))
        return u.where("start IS NOT NULL").select(*g.by, "start", F.col("_c0").alias("first"), F.col("_ce").alias("last"), (F.col("_we") - F.col("_w0")).alias("_weight"))

    win = by_group(merged, by, windows)
    n = merged.groupBy(*by).agg(F.sum("c").alias("n"))
    win = join_same(win, n, by)
    win = win.where(F.col("last") - F.col("first") >= F.greatest(F.lit(4), F.ceil(share * F.col("n"))))
    # medians of competing windows grow with their start, so weight then start decides
    best = win.groupBy(*by).agg(F.max_by(F.struct("first", "last"), F.struct(F.round("_weight", 9), "start")).alias("b"))
    spans = by_group(merged, by, lambda d, g: g.running(d, ["r"], _hi=F.col("c")))
    at = join_same(spans, best.select(*by, "b.first", "b.last"), by)
    mid = F.col("first") + (F.col("last") - F.col("first") - 1) / 2
    inside = lambda p: (p >= F.col("_hi") - F.col("c")) & (p < F.col("_hi"))
    centre = at.groupBy(*by).agg(((F.max(F.when(inside(F.floor(mid)), F.col("r"))) + F.max(F.when(inside(F.ceil(mid)), F.col("r")))) / 2).alias("_dense"))
    fallback = quantiles(r, by, _p70=(F.col("r"), 0.7))
    out = join_same(join_same(n, fallback, by), centre, by, "left")
    c = F.greatest(F.lit(0.30), F.coalesce("_dense", "_p70"))
    tol = F.greatest(F.lit(0.06), F.col("centre") * 0.15)
    return out.withColumn("supported", F.col("_dense").isNotNull()).withColumn("centre", c).select(
        *by, "n", "supported", "centre", F.greatest(F.lit(0.30), F.col("centre") - tol).alias("lower"),
        F.greatest(F.col("centre"), F.least(F.lit(1.0), F.col("centre") + tol)).alias("upper"),
    )


def infer_ratio(df: DataFrame, by: Sequence[str], ratio: str, centre: str, aspect: str) -> DataFrame:
    """Depth ratio from clearly separated profiles, or a fixed prior when there are too few."""
    by = list(by)
    d = df.withColumn("_p", F.col(ratio) <= 0.60 * F.col(centre))
    counts = d.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("_p"), 1)).alias("profiles"), F.max(aspect).alias("_aspect"))
    med = quantiles(d, by, profile_median=(F.when(F.col("_p"), F.col(ratio).cast("double")), 0.5))
    out = join_same(counts, med, by)
    observed = F.col("profiles") >= F.greatest(F.lit(3), F.ceil(0.15 * F.col("n")))
    depth = clip(F.col("profile_median") / F.greatest(F.col("_aspect"), F.lit(0.30)) * 0.68, 0.08, 0.30)
    return out.withColumn("observed", observed).withColumn("depth_ratio", F.when(observed, depth).otherwise(0.16)).drop("_aspect")


def median_blend(samples: DataFrame, by: Sequence[str], score: Column, order: Sequence, k: int, channels: Sequence[str]) -> DataFrame:
    """Per-channel median of the ``k`` highest scored samples."""
    best = top_k(samples, list(by), [score.desc(), *order], k, "_rn")
    return best.groupBy(*by).agg(F.count("*").alias("samples"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in channels])


def reject_outliers(df: DataFrame, channels: Sequence[tuple[str, str]], limit: Column) -> DataFrame:
    """Replace colours farther than ``limit`` from their fallback: pairs are (column, fallback column)."""
    d2 = sum(((F.col(a) - F.col(b)) ** 2 for a, b in channels), F.lit(0.0))
    out = df.withColumn("rejected", F.coalesce(F.sqrt(d2) > limit, F.lit(True)))
    for a, b in channels:
        out = out.withColumn(a, F.when(F.col("rejected"), F.col(b)).otherwise(F.col(a)))
    return out


def gain_normalise(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Gain per source: fleet median of source medians over the source median, within [0.6, 1.8]."""
    per = quantiles(df, by, brightness=(value.cast("double"), 0.5))
    fleet = quantiles(per.where("brightness > 0"), [], fleet=(F.col("brightness"), 0.5))
    target = F.coalesce(fleet.scalar(), F.lit(128.0))
    return per.withColumn("gain", clip(target / F.greatest(F.col("brightness"), F.lit(1.0)), 0.6, 1.8))


def patch_stats(pixels: DataFrame, rects: DataFrame, on: Sequence[str], position: str, cell: int, value: str, patch: str) -> DataFrame:
    """Median per patch by a range join: a patch covers the cells of its ``[lo, hi)`` span, pixels carry their
    own cell, and the equi-join on (on, cell) is checked against the exact bounds."""
    spans = rects.withColumn("_cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))))
    px = pixels.withColumn("_cell", F.expr(f"{position} div {cell}"))
    hit = join_same(px, spans, list(on) + ["_cell"]).where(f"{position} >= lo AND {position} < hi")
    med = quantiles(hit, [patch], median=(F.col(value).cast("double"), 0.5), upper=(F.col(value).cast("double"), 0.62))
    return join_same(med, hit.groupBy(patch).agg(F.count("*").alias("pixels")), [patch])


def agreement(views: DataFrame, by: Sequence[str], iou: Column, held_out: Column, good: float = 0.58) -> DataFrame:
    """Median, p10, minimum, good share of overlaps, and the held-out median."""
    d = views.select(*by, iou.cast("double").alias("_i"), held_out.alias("_h"))
    robust = quantiles(d, by, median_iou=(F.col("_i"), 0.5), p10_iou=(F.col("_i"), 0.1), held_out_median=(F.when(F.col("_h"), F.col("_i")), 0.5))
    plain = d.groupBy(*by).agg(
        F.min("_i").alias("min_iou"), F.avg((F.col("_i") >= good).cast("double")).alias("good_fraction"),
        F.count(F.when(F.col("_h"), 1)).alias("held_out_views"),
    )
    return join_same(plain, robust, list(by))
