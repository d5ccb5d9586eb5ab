"""Scores and scalar conversions built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low, high) -> Column:
    """Bound a value; null stays null (``greatest``/``least`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def unit(c: Column, low: Column, high: Column, neutral: float = 0.5) -> Column:
    """Scale ``low``→0 and ``high``→1; a flat population gives ``neutral``."""
    spread = high - low
    return F.when(spread <= 1e-12, F.lit(float(neutral))).otherwise(clip((c - low) / spread, 0.0, 1.0))


def quality_score(sharp, brightness, contrast, entropy, dark, clipped, central, border, motion, change, has_coverage) -> Column:
    """Weighted frame quality in [0, 1]. The first, third, motion and change inputs are already unit-scaled."""
    exposure = F.greatest(F.lit(0.0), 1 - F.abs(brightness - 0.5) / 0.48)
    coverage = F.when(
        has_coverage, F.least(F.lit(1.0), central / 0.22) * F.when(border > 0.70, 0.75).otherwise(1.0)
    ).otherwise(0.5)
    score = (
        0.32 * sharp + 0.18 * exposure + 0.12 * contrast + 0.10 * clip(entropy / 7.5, 0.0, 1.0)
        + 0.17 * coverage + 0.06 * motion + 0.05 * change - 0.15 * clip(dark + clipped, 0.0, 0.5) * 1.4
    )
    return clip(score, 0.0, 1.0)


def detail_score(sharpness, density, entropy, margin, solidity, extent, coverage) -> Column:
    """Candidate view score with log-damped sharpness."""
    sharp = clip(F.log1p(sharpness) / F.log(F.lit(1200.0)), 0.0, 1.0)
    return (
        0.44 * sharp + 0.20 * clip(density / 0.16, 0.0, 1.0) + 0.13 * clip(entropy / 5.0, 0.0, 1.0)
        + 0.12 * clip(margin / 0.10, 0.0, 1.0) + 0.04 * solidity + 0.02 * extent + 0.05 * F.sqrt(coverage)
    )


def face_score(face_ratio, coverage, sharpness, skin) -> Column:
    """Rectified-face score; visible skin lowers it."""
    base = face_ratio * face_ratio * face_ratio * F.sqrt(F.greatest(coverage, F.lit(1e-6)))
    return base * F.log1p(F.greatest(sharpness, F.lit(0.0))) * F.greatest(F.lit(0.15), 1 - 2.5 * skin)


def aspect_penalty(aspect, centre, limit: float = 0.28) -> Column:
    """Share of the allowed log-aspect deviation used up."""
    return clip(F.abs(F.log(aspect / centre)) / limit, 0.0, 1.0)


def secondary_score(solidity, extent, margin, mask_area, detail, penalty) -> Column:
    """Score of a plain (unmarked) view of a two-family capture."""
    return (
        0.35 * solidity + 0.25 * extent + 0.20 * clip(margin / 0.10, 0.0, 1.0) + 0.10 * clip(mask_area / 0.55, 0.0, 1.0)
        + 0.10 * (1 - clip(detail / 3.0, 0.0, 1.0)) - 0.05 * penalty
    )


def to_depth(prediction: Column, slope: Column, offset: Column, space: str, eps: float = 1e-9) -> Column:
    """Metric depth from a prediction: ``inverse`` = 1/(slope·p+offset), ``scale`` = slope·p; else null."""
    value = slope * prediction + offset if space == "inverse" else slope * prediction
    return F.when(value > eps, 1 / value if space == "inverse" else value)


def held_out_confidence(error: Column, limit: float) -> Column:
    """1 at no held-out error, 0 at ``limit`` or when unmeasured."""
    return F.coalesce(clip(1 - error / limit, 0.0, 1.0), F.lit(0.0))


def track_weight(length: Column, error: Column) -> Column:
    """Observation weight from track length and reprojection error."""
    half = error / 2
    return F.least(length, F.lit(10)) / 10 / (1 + half * half)


def aspect_error(width: Column, height: Column) -> Column:
    """Relative distance of a frame's long/short ratio from the nearest camera aspect."""
    # Common camera aspect ratios.
    common = [1.0, 4 / 3, 3 / 2, 16 / 9]
    ratio = F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))
    return F.least(*[F.abs(ratio - a) / a for a in common])
