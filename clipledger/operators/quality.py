"""Frame and clip quality: population scores, flags, capture warnings, preflight and source guard."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import scoring
from clipledger.functions.rules import Rule, apply_gates
from clipledger.operators.aggregates import circular_coverage, quantiles
from clipledger.operators.groups import by_group
from clipledger.session import join_same


def score_frames(frames: DataFrame, by: Sequence[str], order: Sequence[str], *, sharpness: Column, brightness: Column, contrast: Column,
                 entropy: Column, dark: Column, clipped: Column, central: Column, border: Column, motion: Callable, change: Callable,
                 has_coverage: Column) -> DataFrame:
    """Add ``quality``: population-scaled sharpness, contrast, motion and change with absolute terms.

    ``motion`` and ``change`` get the ordered window of the clip and compare a frame with the one before.
    """
    raw = {"_sharp": F.log1p(sharpness), "_con": contrast, "_mot": F.col("_mot_raw"), "_chg": F.col("_chg_raw")}

    def step(d, g):
        d = g.slide(d, order, 1, 0, _mot_raw=motion, _chg_raw=change)
        d = g.attach_quantiles(d, **{f"{n}_{p}": (c, p / 100) for n, c in raw.items() for p in (10, 90)})
        u = {n: scoring.unit(c, F.col(f"{n}_10"), F.col(f"{n}_90"), 0.0 if n == "_chg" else 0.5) for n, c in raw.items()}
        score = scoring.quality_score(u["_sharp"], brightness, u["_con"], entropy, dark, clipped, central, border, u["_mot"], u["_chg"], has_coverage)
        return d.withColumn("quality", score).drop("_mot_raw", "_chg_raw", *[f"{n}_{p}" for n in raw for p in (10, 90)])

    return by_group(frames, by, step)


def frame_flags(frames: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Add ``flags`` (names of the tests that hold) and ``usable``; no row is dropped."""
    named = F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])
    return frames.withColumn("flags", F.filter(named, lambda x: x.isNotNull())).withColumn("usable", F.size("flags") == 0)


def excluded_by_reason(flagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of excluded frames per reason; the frames themselves stay rows of ``flagged``."""
    return flagged.select(*by, F.explode("flags").alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("frames"))


def capture_warnings(clips: DataFrame, frames: DataFrame, by: Sequence[str], limits: dict | None = None) -> DataFrame:
    """Advisory warnings on a clip: length, size, rate, keyframes and typical frame measures."""
    # Warning limits.
    lim = {"duration_s": 8.0, "width": 1280, "height": 720, "fps": 20.0, "keyframes": 8, "sharpness": 35.0, "clipped": 0.12, "border": 0.80, "coverage": 0.05}
    lim |= limits or {}
    d = frames.select(*by, *[F.col(c).cast("double").alias(c) for c in ("sharpness", "dark_clipped", "border_touch", "central_coverage")])
    q = quantiles(d, by, _sharp=(F.col("sharpness"), 0.5), _clip=(F.col("dark_clipped"), 0.5), _border=(F.col("border_touch"), 0.75), _cov=(F.col("central_coverage"), 0.75))
    j = join_same(clips, q, list(by), "left")
    rules = [
        Rule("short_capture", F.col("duration_s") < lim["duration_s"], warning=True),
        Rule("low_resolution", (F.col("display_width") < lim["width"]) | (F.col("display_height") < lim["height"]), warning=True),
        Rule("low_frame_rate", F.col("fps") < lim["fps"], warning=True),
        Rule("few_keyframes", F.col("keyframes") < lim["keyframes"], warning=True),
        Rule("low_sharpness", F.col("_sharp") < lim["sharpness"], warning=True),
        Rule("exposure_clipped", F.col("_clip") > lim["clipped"], warning=True),
        Rule("touches_border", F.col("_border") > lim["border"], warning=True),
        Rule("little_central_subject", F.col("_cov") < lim["coverage"], warning=True),
    ]
    return apply_gates(j, rules).drop("_sharp", "_clip", "_border", "_cov")


def source_guard(clips: DataFrame) -> DataFrame:
    """Reject the metadata signature of a screen recording: silent, fast, display-shaped."""
    d = clips.withColumn("aspect_error", scoring.aspect_error(F.col("display_width"), F.col("display_height")))
    fast = ~F.col("has_audio") & (F.col("fps") >= 45.0)
    odd = F.col("aspect_error") > 0.04
    return apply_gates(d, [
        Rule("screen_recording", fast & odd, "metadata strongly indicates a screen recording"),
        Rule("silent_high_frame_rate", fast & ~odd, "silent high-frame-rate source", warning=True),
    ])


def coverage_preflight(views: DataFrame, by: Sequence[str], angle: Column, selected: Column, *, min_views=8, min_fraction=0.20, min_span=120.0,
                       min_bins=5, min_opposing=90.0) -> DataFrame:
    """Check registered views and angular coverage of all views and of the selected ones before costly work."""
    by = list(by)
    v = views.select(*by, angle.alias("_a"), selected.alias("_sel"))
    counts = v.groupBy(*by).agg(F.count("*").alias("total"), F.count(F.when(F.col("_sel"), 1)).alias("registered"))
    tagged = v.select(*by, "_a", F.explode(F.when(F.col("_sel"), F.array(F.lit("all"), F.lit("selected"))).otherwise(F.array(F.lit("all")))).alias("_set"))
    cov = circular_coverage(tagged, by + ["_set"], F.col("_a"), F.lit(0.0))
    wide = cov.groupBy(*by).pivot("_set", ["all", "selected"]).agg(F.max("span").alias("span"), F.max("bins").alias("bins"), F.max("max_pair_angle").alias("opposing"))
    rules = [
        Rule("too_few_registered_views", F.col("registered") < min_views),
        Rule("registered_fraction_too_low", F.col("registered") / F.col("total") < min_fraction),
    ]
    for s in ("all", "selected"):
        rules += [
            Rule(f"{s}_span_too_small", F.col(f"{s}_span") < min_span),
            Rule(f"{s}_bins_too_few", F.col(f"{s}_bins") < min_bins),
            Rule(f"{s}_opposing_angle_too_small", F.col(f"{s}_opposing") < min_opposing),
        ]
    return apply_gates(join_same(counts, wide, by, "left"), rules)
