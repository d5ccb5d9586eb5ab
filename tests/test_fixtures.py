"""Operators on generated captures with known outcomes."""

import json
import math
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from clipledger.functions import geometry as geo
from clipledger.operators import aggregates as agg, graph, lineage, models, predict as pr, quality, selection, splits, surfaces as sf, windows
from clipledger.sources import readers, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])
CAM = "rotation array<double>, translation array<double>, focal double, cx double, cy double, k1 double, width int, height int"


def test_frame_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (6, 7, 3))
    px = spark.createDataFrame([(1, y, x, *map(int, img[y, x])) for y in range(6) for x in range(7)], "f int, y int, x int, b int, g int, r int")
    got = agg.frame_metrics(px, ["f"]).first()
    grey = np.rint(img @ np.array([0.114, 0.587, 0.299]))
    pad = np.pad(grey, 1, mode="reflect")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * grey
    p = np.unique(grey, return_counts=True)[1] / grey.size
    assert got.brightness_mean == pytest.approx(grey.mean() / 255) and got.contrast_stddev == pytest.approx(grey.std() / 255)
    assert got.sharpness_laplacian == pytest.approx(lap.var()) and got.entropy_bits == pytest.approx(-(p * np.log2(p)).sum())
    assert got.dark_fraction == pytest.approx((grey <= 12).mean()) and got.clipped_fraction == pytest.approx((grey >= 245).mean())


def test_mask_coverage_counts_corners_twice(spark):
    m = np.zeros((10, 20), int)
    m[0, 0] = m[5, 10] = 1
    px = spark.createDataFrame([(1, y, x, int(m[y, x])) for y in range(10) for x in range(20)], "f int, y int, x int, hit int")
    got = agg.mask_coverage(px, ["f"], F.lit(20), F.lit(10)).first()
    assert got.coverage == pytest.approx(2 / 200) and got.border_touch == pytest.approx(2 / 60)
    assert got.central_coverage == pytest.approx(1 / m[2:8, 3:17].size)


def test_bilinear_matches_formula(spark):
    img = np.arange(12, dtype=float).reshape(3, 4) ** 1.5
    image = spark.createDataFrame([(0, y, x, float(img[y, x])) for y in range(3) for x in range(4)], "c int, y long, x long, value double")
    pts = spark.createDataFrame([(0, 1, 1.25, 0.5), (0, 2, -3.0, 9.0)], "c int, p int, u double, v double")
    got = {r.p: r.value for r in sf.bilinear(pts, image, ["c"], "p", 4, 3).collect()}
    assert got[1] == pytest.approx(0.5 * (0.75 * img[0, 1] + 0.25 * img[0, 2]) + 0.5 * (0.75 * img[1, 1] + 0.25 * img[1, 2]))
    assert got[2] == pytest.approx(img[2, 0], abs=1e-4)


def ring(spark, views=24, size=64, shape=(0.8, 0.6, 0.5), clips=1):
    from bench import carve_fixture

    return carve_fixture(spark, clips, size)


def test_carve_recovers_the_solid(spark):
    ids, views, n = ring(spark, size=32)
    grid = sf.voxel_grid(ids, n)
    kept = sf.carve(grid, views, ["clip"], ["iz", "iy", "ix"], "view", 0, "reject")
    truth = ((F.col("x") / 0.8) ** 2 + (F.col("y") / 0.6) ** 2 + (F.col("z") / 0.5) ** 2) <= 1
    t, k = grid.where(truth).count(), kept.count()
    both = kept.where(truth).count()
    assert both / (t + k - both) > 0.72 and both / t > 0.97


def test_one_bad_mask_needs_a_limit_of_one(spark):
    ids, views, n = ring(spark, size=16)
    bad = views.withColumn("mask", F.when(F.col("view") == 0, F.transform("mask", lambda x: F.lit(0).cast("long"))).otherwise(F.col("mask")))
    grid = sf.voxel_grid(ids, n)
    count = lambda v, k: sf.carve(grid, v, ["clip"], ["iz", "iy", "ix"], "view", k, "abstain").count()
    assert count(bad, 0) == 0 and count(bad, 1) >= count(views, 0) > 0


def test_mask_bitmaps_keep_every_pixel(spark):
    px = [(v, y, x, 13, 11) for v in (1, 2) for y in range(11) for x in range(13) if (x * y + v) % 3 == 0]
    d = sf.mask_bitmaps(spark.createDataFrame(px, "view int, y int, x int, width int, height int"), [], "view")
    for r in d.collect():
        bits = np.unpackbits(np.array(r.mask, dtype=np.int64).view(np.uint8), bitorder="little")[: 13 * 11]
        assert {(p // 13, p % 13) for p in np.flatnonzero(bits)} == {(y, x) for v, y, x, *_ in px if v == r.view}


def test_fused_depth_is_signed(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    views = spark.createDataFrame([(0, 0, eye, [0.0, 0.0, 0.0], 10.0, 2.0, 2.0, 0.0, 5, 5, [2.0] * 25, [1.0] * 25)], f"clip int, view int, {CAM}, depth_map array<float>, conf_map array<float>")
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.9), (0, 2, 0.0, 0.0, 2.1), (0, 3, 0.0, 0.0, 9.0)], "clip int, id int, x double, y double, z double")
    got = {r.id: r.tsdf for r in sf.fuse(pts, views, ["clip"], ["id"], "view", 0.4).collect()}
    assert got[1] == pytest.approx(0.25) and got[2] == pytest.approx(-0.25) and got[3] is None


def test_nearer_face_hides_the_other(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    views = spark.createDataFrame([(0, 0, eye, [0.0, 0.0, 0.0], 10.0, 10.0, 10.0, 0.0, 20, 20)], f"clip int, view int, {CAM}")
    tri = lambda z: ([-z / 2, -z / 2, z], [z / 2, -z / 2, z], [0.0, z / 2, z])
    faces = spark.createDataFrame([(0, 1, *tri(2.0)), (0, 2, *tri(4.0)), (0, 3, *tri(-1.0))], "clip int, fid int, p array<double>, q array<double>, r array<double>")
    pf = sf.project_faces(faces, views, ["clip"], "view")
    z = sf.zbuffer(pf, ["clip", "view"], "fid")
    assert {r.fid for r in z.collect()} == {1}
    seen = sf.visible_faces(pf, z, ["clip", "view"], "fid", 0.1, F.lit(1.0))
    assert [r.fid for r in seen.collect()] == [1]


CUBE_V = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
CUBE_F = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def test_mesh_gate(spark):
    v = [("cube", i, *p) for i, p in enumerate(CUBE_V)] + [("two", i + 8 * k, p[0] + 5 * k, *p[1:]) for k in (0, 1) for i, p in enumerate(CUBE_V)] + [("sheet", i, float(i % 2), float(i // 2), 0.0) for i in range(4)]
    f = [("cube", i, *t) for i, t in enumerate(CUBE_F)] + [("two", i + 12 * k, *[c + 8 * k for c in t]) for k in (0, 1) for i, t in enumerate(CUBE_F)] + [("sheet", 0, 0, 1, 3), ("sheet", 1, 0, 3, 2)]
    d = sf.mesh_metrics(spark.createDataFrame(v, "m string, vid long, x double, y double, z double"), spark.createDataFrame(f, "m string, fid long, v0 long, v1 long, v2 long"), ["m"])
    got = {r.m: r for r in d.collect()}
    assert got["cube"].accepted and got["cube"].euler == 2 and got["cube"].volume == pytest.approx(1) and got["cube"].area == pytest.approx(6)
    assert got["two"].reasons == ["too_many_components"] and "open_boundary" in got["sheet"].reasons


def test_projection_round_trip(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    rot, tr = F.array(*[F.lit(float(x)) for x in (c, -s, 0, s, c, 0, 0, 0, 1)]), F.array(F.lit(0.1), F.lit(-0.2), F.lit(4.0))
    cam = [F.lit(900.0), F.lit(640.0), F.lit(360.0), F.lit(0.03)]
    p = geo.project(F.lit(0.3), F.lit(-0.2), F.lit(0.5), rot, tr, *cam)
    back = geo.backproject(p["u"], p["v"], p["z"], rot, tr, *cam)
    r = spark.range(1).select(back.alias("b")).first().b
    assert (r.x, r.y, r.z) == pytest.approx((0.3, -0.2, 0.5), abs=1e-6)


def test_orbit_fit_finds_a_tilted_circle(spark):
    t = np.radians(np.arange(0, 360, 10))
    pts = np.stack([3 * np.cos(t), 3 * np.sin(t), np.zeros_like(t)], 1)
    a = math.radians(25)
    rot = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    rows = [(0, i, *map(float, p)) for i, p in enumerate(pts @ rot.T + [1, 2, 3])]
    d = graph.orbit_fit(spark.createDataFrame(rows, "c int, i int, x double, y double, z double"), ["c"], ["i"], "x", "y", "z").orderBy("i").collect()
    assert all(r.radius == pytest.approx(3) and r.elevation == pytest.approx(0, abs=1e-6) for r in d)
    steps = {round(b.azimuth - a.azimuth, 6) for a, b in zip(d, d[1:])}
    assert steps in ({10.0}, {-10.0})


def test_level_offsets_solve_the_normal_equations(spark):
    e = [(0, 1, 2.0, 1.0), (1, 2, -1.0, 2.0), (0, 2, 0.5, 1.0)]
    got = {r.node: r.offset for r in graph.level_offsets(spark.createDataFrame(e, "a int, b int, diff double, w double")).collect()}
    m, b = np.eye(3) * 0.1**2, np.zeros(3)
    for i, j, d, w in e:
        row = np.zeros(3)
        row[i], row[j] = 1, -1
        m += w * np.outer(row, row)
        b += w * d * row
    assert [got[i] for i in range(3)] == pytest.approx(np.linalg.solve(m, b), abs=1e-6)


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(500, 501)], "src long, dst long"))
    assert {(r.component, r["count"]) for r in graph.components(e).groupBy("component").count().collect()} == {(0, 201), (500, 2)}


def test_hash_split_ignores_order_and_keeps_both_sides(spark):
    d = spark.range(50).select(F.concat(F.lit("int:"), F.col("id").cast("string")).alias("t"))
    one = {(r.token, r.role) for r in splits.hash_split(d, [], F.col("t")).collect()}
    two = {(r.token, r.role) for r in splits.hash_split(d.orderBy(F.desc("t")), [], F.col("t"), 0.67).collect()}
    assert one == two and sum(r == "calibration" for _, r in one) == 34
    few = splits.hash_split(d.limit(1), [], F.col("t")).collect()
    assert [r.role for r in few] == ["calibration"]
    with pytest.raises(ValueError):
        splits.hash_split(d, [], F.col("t"), 1.0)


def test_source_guard_decisions(spark):
    d = spark.createDataFrame([("a", True, 30.0, 1620, 1080), ("b", False, 60.0, 1000, 2300), ("c", False, 60.0, 1920, 1080)], "clip string, has_audio boolean, fps double, display_width int, display_height int")
    got = {r.clip: (r.accepted, r.warnings) for r in quality.source_guard(d).collect()}
    assert got == {"a": (True, []), "b": (False, []), "c": (True, ["silent_high_frame_rate"])}


def test_candidates_fall_back_and_report(spark):
    rows = [("x", "general", 0, True, None), ("x", "slab", 1, True, None), ("y", "general", 0, False, "gate"), ("y", "slab", 1, True, None), ("z", "general", 0, False, "gate"), ("z", "soft", 2, False, "soft: thin")]
    d = selection.select_candidate(spark.createDataFrame(rows, "c string, name string, p int, ok boolean, why string"), ["c"], "name", F.col("p"), F.col("ok"), F.col("why"))
    got = {r.c: (r.selected, r.reasons) for r in d.collect()}
    assert got == {"x": ("general", []), "y": ("slab", []), "z": ("needs_recapture", ["gate", "soft: thin"])}


def test_cadence_takes_every_frame_at_a_rate_above_the_source(spark):
    rows = [(c, i, i / fps, fps) for c, fps in ((0, 30.0), (1, 240.0)) for i in range(12)]
    d = spark.createDataFrame(rows, "clip int, frame int, t double, fps double")
    out = selection.sample_cadence(d, ["clip"], "t", ["frame"], 60.0, F.col("fps"), 100, F.lit(1.0)).collect()
    assert sorted(r.frame for r in out if r.clip == 0) == list(range(12))  # half a frame spans the interval
    assert sorted(r.frame for r in out if r.clip == 1) == [0, 4, 8]


def test_boundary_cut_is_listed_but_not_a_cut(spark):
    a, b = [9.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 9.0]
    frames = [("c", i, float(i), b if i >= 99 else a, [0.9] if i >= 99 else [0.1]) for i in range(101)]
    frames += [("m", i, float(i), b if i >= 50 else a, [0.9] if i >= 50 else [0.1]) for i in range(101)]
    d = spark.createDataFrame(frames, "clip string, i int, t double, hist array<double>, colour array<double>")
    got = {(r.clip, r.i): r.verdict for r in windows.scene_cuts(d, ["clip"], ["i"], "t", F.lit(100.0), "hist", "colour").where("verdict IS NOT NULL").collect()}
    assert got == {("c", 98): "boundary", ("m", 49): "cut"}


def test_mesh_text_reads_relative_ids(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1/1 2/2/2 3 4\nf -4 -3 -2\n")
    v, f = readers.read_mesh_text(spark, str(tmp_path / "m.obj"))
    assert v.count() == 4
    assert sorted((r.line, r.part, r.v0, r.v1, r.v2) for r in f.collect()) == [(4, 0, 0, 1, 2), (4, 1, 0, 2, 3), (5, 0, 0, 1, 2)]


def test_analysis_and_sparse_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1", "frames": [{"candidate_index": 0, "path": "f0"}, {"candidate_index": 1, "path": "f1"}]}, indent=1))
    d = readers.read_analysis(spark, str(tmp_path / "a.json"))
    assert [(r.position, r.frame.path) for r in d.orderBy("position").collect()] == [(0, "f0"), (1, "f1")]
    rows = [("c", (900.0, 640.0, 360.0, 0.0), [("v1", [1.0] * 9, [0.0] * 3)], [(7, [1.0, 2.0, 3.0], 0.5, [("v1", 10.0, 20.0), ("v2", 1.0, 2.0)])])]
    schema = "clip_id string, camera struct<focal: double, cx: double, cy: double, k1: double>, images array<struct<name: string, rotation: array<double>, translation: array<double>>>, points array<struct<id: bigint, xyz: array<double>, error: double, track: array<struct<view: string, u: double, v: double>>>>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "sfm"))
    views, points, obs = readers.read_sfm(spark, str(tmp_path / "sfm"))
    assert views.first().focal == 900.0 and points.first().track_length == 2 and {r.view for r in obs.collect()} == {"v1", "v2"}


def test_predictions_reader_finds_a_tampered_array(spark, tmp_path):
    d = spark.createDataFrame([("b", 1, 2, [1.0, 2.0], "metric"), ("b", 1, 2, [1.0, -2.0], "metric")], "backend string, h int, w int, values array<float>, representation string")
    d = d.withColumn("output_sha256", lineage.array_hash(F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")), "float32", F.array("h", "w")))
    d.write.parquet(str(tmp_path / "p"))
    got = sorted((r.hash_matches, r.reasons) for r in readers.read_predictions(spark, str(tmp_path / "p")).collect())
    assert got == [(False, ["not_positive"]), (True, [])]


def test_publish_once_and_never_nan(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0)], "b int, a double")
    sinks.publish(d, str(tmp_path / "r"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))) == {"a": 2.0, "b": 1}
    with pytest.raises(Exception, match="already exists"):
        sinks.publish(d, str(tmp_path / "r"))
    with pytest.raises(Exception, match="not finite"):
        sinks.publish(spark.createDataFrame([(1, float("nan"))], "b int, a double"), str(tmp_path / "n"))


class Doubler:
    name = "doubler"

    def __init__(self, ok=True, drop=False):
        self.ok, self.drop = ok, drop

    def is_available(self):
        return self.ok

    def predict(self, batch):
        out = pd.DataFrame({"y": batch["x"] * 2})
        return out.iloc[1:] if self.drop else out


def test_predictor_contract_and_reuse(spark):
    d = spark.createDataFrame([(i, float(i), f"h{i}") for i in range(6)], "id long, x double, h string")
    got = pr.predict(d, Doubler(), ["id"], ["x"], "y double")
    assert {r.id: r.y for r in got.collect()} == {i: 2.0 * i for i in range(6)}
    for bad, text in ((Doubler(ok=False), "not available"), (Doubler(drop=True), "returned")):
        with pytest.raises(Exception, match=text):
            pr.predict(d, bad, ["id"], ["x"], "y double").collect()
    cache = spark.createDataFrame([(0, "h0", -1.0), (1, "old", -1.0)], "id long, h string, y double")
    got = {r.id: r.y for r in pr.predict_missing(d, cache, Doubler(), ["id"], ["x"], ["h"], "y double").collect()}
    assert got == {0: -1.0, 1: 2.0, 2: 4.0, 3: 6.0, 4: 8.0, 5: 10.0}


def test_model_validation_names_the_problem(spark):
    good = (["a", "b"], [0.0], [1.0], [[1.0], [2.0]], [0.0, 0.0], 1.0, [[0.0], [1.0]], [1.0, 1.0], [5.0, 5.0])
    bad = (["a", "b"], [0.0], [0.0], [[1.0], [2.0]], [0.0, 0.0], 1.0, [[0.0], [1.0]], [1.0, 1.0], [0.5, 5.0])
    schema = "families array<string>, mean array<double>, scale array<double>, weights array<array<double>>, bias array<double>, temperature double, centroids array<array<double>>, p99 array<double>, reject array<double>"
    got = [r.reasons for r in models.model_problems(spark.createDataFrame([good, bad], schema)).collect()]
    assert got == [[], ["scale_not_positive", "distances_not_ordered"]]


def test_frozen_digest_depends_on_content_only(spark, hot):
    d = spark.range(2500).select((F.col("id") % 2).alias("g"), "id")
    one = {r.g: r.digest for r in lineage.freeze(d, ["g"], "id", F.lit("x")).collect()}
    two = {r.g: r.digest for r in lineage.freeze(d.repartition(5), ["g"], "id", F.lit("x")).collect()}
    three = {r.g: r.digest for r in lineage.freeze(d, ["g"], "id", F.when(F.col("id") == 8, "y").otherwise("x")).collect()}
    assert one == two and one[1] == three[1] and one[0] != three[0]


def test_loop_ranges_cover_the_pairs(spark):
    from clipledger.operators.joins import loop_ranges

    d = spark.createDataFrame([("c", f"n{i:02d}") for i in range(23)], "c string, n string")
    got = {r.anchor: (r.first_partner, r.last_partner, r.partners) for r in loop_ranges(d, ["c"], ["n"], "n", 4, 3).collect()}
    anchors = list(range(0, 23, 3))
    want = {}
    for i in anchors:
        ok = [j for j in anchors if j - i > 4]
        if ok:
            want[f"n{i:02d}"] = (f"n{ok[0]:02d}", f"n{ok[-1]:02d}", len(ok))
    assert got == want
    with pytest.raises(ValueError):
        loop_ranges(d, ["c"], ["n"], "n", -1, 3)


def test_pair_quantile_of_small_and_large_groups(spark, monkeypatch):
    from clipledger.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 8)
    rng = np.random.default_rng(3)
    data = {"one": rng.random((1, 3)), "small": rng.random((7, 3)), "large": np.round(rng.random((45, 3)), 1)}
    rows = [(k, i, v.tolist()) for k, m in data.items() for i, v in enumerate(m)]
    got = {r.k: r.q for r in pairs.pair_quantile(spark.createDataFrame(rows, "k string, i int, v array<double>"), ["k"], "v", ["i"], 0.9, "q").collect()}
    for k, m in data.items():
        d = np.abs(m[:, None] - m[None]).mean(-1)[np.triu_indices(len(m), 1)]
        assert (k not in got) if not len(d) else got[k] == pytest.approx(np.quantile(d, 0.9))
