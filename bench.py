"""Time all registered queries, or those of BENCH_ONLY (comma separated), on the tables of BENCH_SF_DIR with
BENCH_CPUS threads. The headline queries come first; when BENCH_SECONDS (1,500) have passed, the rest is named as not
timed.

Prints one JSON line. Each query is planned, run in full through the no-op sink and timed once, after a warm-up of
the session. ``carve_96`` times the voxel carve of the baseline (96^3 voxels, 24 views) on generated captures, after one
to warm up: one clip, and 8 and 64 clips at once.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


HEADLINE = [
    "keyframes", "quality", "entropy", "roi_coverage", "robust_unit", "weighted_median", "mad", "circular_coverage", "pca3", "robust_extent", "outlier_shell", "clip_features", "dense_band", "hist_distance",
    "gates", "preflight", "warnings", "project", "lag_change", "rolling_outlier", "temporal_runs", "scene_cuts", "asof_interp", "top_k", "best_by", "coverage_select", "farthest_point", "cadence", "view_pairs",
    "consensus", "arbitrate", "huber_fit", "tukey_fit", "backend_rollup", "point_support", "vote_carve", "weighted_fuse", "nearest_per_cell", "reproject_classify", "components", "smooth_labels", "taubin",
    "prune", "classify", "bootstrap", "hash_split", "dedup_obs", "even_sample", "audit_sets", "resume_plan", "freeze", "stream_runs", "stream_hints",
]


def carve_fixture(spark, clips: int, size: int = 96):
    """Clips of an ellipsoid seen by 24 views in three rings; masks are drawn from the same ellipsoid."""
    import numpy as np

    w = h = 192
    focal, radius = 180.0, 3.7
    axes = np.array([0.8, 0.6, 0.5])
    rows = []
    for ring, elev in enumerate((-20.0, 10.0, 40.0)):
        for k in range(8):
            az, el = math.radians(45 * k + 15 * ring), math.radians(elev)
            c = radius * np.array([math.cos(el) * math.cos(az), math.cos(el) * math.sin(az), math.sin(el)])
            forward = -c / np.linalg.norm(c)
            right = np.cross(forward, [0, 0, 1.0])
            right /= np.linalg.norm(right)
            rot = np.stack([right, np.cross(forward, right), forward])
            v, u = np.mgrid[0:h, 0:w]
            rays = np.stack([(u - w / 2) / focal, (v - h / 2) / focal, np.ones((h, w))], -1) @ rot
            a = ((rays / axes) ** 2).sum(-1)
            b = 2 * (rays / axes * (c / axes)).sum(-1)
            disc = b * b - 4 * a * (((c / axes) ** 2).sum() - 1)
            rows.append((ring * 8 + k, rot.ravel().tolist(), (-rot @ c).tolist(), focal, w / 2, h / 2, 0.0, w, h, np.packbits((disc >= 0).ravel(), bitorder="little").view(np.int64).tolist()))
    schema = "view int, rotation array<double>, translation array<double>, focal double, cx double, cy double, k1 double, width int, height int, mask array<bigint>"
    from pyspark.sql import functions as F

    ids = spark.range(clips).withColumnRenamed("id", "clip")
    views = spark.createDataFrame(rows, schema).withColumn("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(clips - 1).cast("long"))))
    return ids, views, size


def main() -> None:
    from clipledger.operators.fold import carve_grid
    from clipledger.plans import QUERIES
    from clipledger.session import build_session

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    spark = build_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(QUERIES["top_k"](spark, path))
    run(QUERIES["predict"](spark, path))
    times: dict[str, float] = {}
    limit, began, late = float(os.environ.get("BENCH_SECONDS", "1500")), time.time(), []
    names = [n for n in HEADLINE if n in QUERIES] + [n for n in QUERIES if n not in HEADLINE]
    for name in names if not only or only == ["all"] else [n for n in names if n in only]:
        if time.time() - began > limit:
            late.append(name)
            continue
        fn, start = QUERIES[name], time.time()
        run(fn(spark, path))
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    extra = {}
    if not only or "carve_96" in only or only == ["all"]:
        for clips in (1, 1, 8, 64):
            ids, views, size = carve_fixture(spark, clips)
            start = time.time()
            kept = carve_grid(ids, views, ["clip"], "view", size, limit=0, outside="reject").count()
            extra[f"carve_96_24_views_{clips}_clips"] = round(time.time() - start, 3)
            extra[f"carve_voxels_{clips}"] = kept
    extra["headline_seconds"] = round(sum(times.get(n, 0) for n in HEADLINE), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": path.rsplit("sf", 1)[-1], "cpus": cpus, "extra": extra, "not_timed": late}))


if __name__ == "__main__":
    main()
