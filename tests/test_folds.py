"""Views folded over blocks and points, regions, exact medians and fits, readers by blocks, job state."""

import json
import random

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from clipledger.operators import fits, fold, regions
from clipledger.operators import graph as gr
from clipledger.operators import surfaces as sf
from clipledger.operators.binned import median_of
from clipledger.sources import readers as rd
from clipledger.streaming import streams as st

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
CAM = "rotation array<double>, translation array<double>, focal double, cx double, cy double, k1 double, width int, height int"


@pytest.fixture(scope="module")
def views(spark):
    """Masks of noise, stripes, nothing and everything, bent and turned cameras, one among the voxels."""
    r = np.random.default_rng(3)
    rows = []
    for k in range(10):
        a = r.normal(size=(3, 3)) * 0.25 + np.eye(3)
        w, h = (33, 21) if k % 2 else (64, 48)
        y, x = np.mgrid[0:h, 0:w]
        mask = [r.random((h, w)) > 0.4, (x // 7) % 2 == 0, np.zeros((h, w), bool), np.ones((h, w), bool), (x - w / 2) ** 2 + (y - h / 2) ** 2 < (h / 2.2) ** 2][k % 5]
        bits = np.packbits(np.append(mask.ravel(), np.zeros(-mask.size % 64, bool)), bitorder="little").view(np.int64).tolist()
        t = [float(r.normal() * 0.2), float(r.normal() * 0.2), 0.4 if k == 7 else 3.0 + k / 5]
        rows.append((1 + k % 2, k, a.ravel().tolist(), t, 22.0, w / 2, h / 2, (0.1, -0.15, 0.0)[k % 3], w, h, bits))
    return spark.createDataFrame(rows, f"clip int, view int, {CAM}, mask array<bigint>")


@pytest.mark.parametrize(("outside", "limit"), [("abstain", 0), ("abstain", 2), ("reject", 1), ("reject", 3), ("abstain", 9)])
def test_bricks_decide_like_voxels(spark, views, monkeypatch, outside, limit):
    clips = spark.createDataFrame([(1,), (2,), (3,)], "clip int")
    key = ["clip", "iz", "iy", "ix"]
    one = lambda d: sorted(tuple(x) for x in d.select(*key, "x", "y", "z", "rejections").collect())
    want = one(sf.carve(sf.voxel_grid(clips, 21), views, ["clip"], key[1:], "view", limit, outside))
    assert one(fold.carve_grid(clips, views, ["clip"], "view", 21, limit=limit, outside=outside)) == want
    monkeypatch.setattr(fold, "BLOCK", 8)
    monkeypatch.setattr(fold, "UNIT", 100)
    assert one(fold.carve_grid(clips, views, ["clip"], "view", 21, limit=limit, outside=outside)) == want
    assert one(sf.carve(sf.voxel_grid(clips, 21), views, ["clip"], key[1:], "view", limit, outside)) == want
    assert sum(r[0] == 3 for r in want) == 21**3  # no view, no rejection


def test_border_is_exact_before_rounding(spark):
    """u = 4.6 lies within a width of 5 and goes to pixel 4; u = -0.3 lies outside, though its nearest pixel is 0."""
    views = spark.createDataFrame([(0, 0, EYE, [0.0, 0.0, 0.0], 10.0, 2.0, 2.0, 0.0, 5, 5, [2**25 - 1])], f"clip int, view int, {CAM}, mask array<bigint>")
    pts = spark.createDataFrame([(0, 1, 0.26, 0.0, 1.0), (0, 2, -0.23, 0.0, 1.0), (0, 3, 0.31, 0.0, 1.0)], "clip int, id int, x double, y double, z double")
    assert {r.id: r.support for r in sf.point_support(pts, views, ["clip"], "id", "view").collect()} == {1: 1, 2: 0, 3: 0}
    rejected = lambda p: {r.id: r.rejections for r in sf.carve(pts, views, ["clip"], ["id"], "view", 9, p).collect()}
    assert rejected("abstain") == {1: 0, 2: 0, 3: 0} and rejected("reject") == {1: 1, 2: 0, 3: 1}


def test_depth_edges_and_confidence(spark):
    depth = np.full((6, 6), 2.0)
    depth[:, 3:] = 3.0
    edges = fold.depth_edges(depth, 1.0, 0.5)
    assert edges[:, 2:4].all() and not edges[:, [0, 1, 4, 5]].any()
    views = spark.createDataFrame([(0, k, EYE, [0.0, 0.0, 0.0], 10.0, 2.0, 2.0, 0.0, 6, 6, depth.ravel().tolist(), c) for k, c in ((0, 0.5), (1, 0.25))], f"clip int, view int, {CAM}, depth_map array<double>, depth_conf double")
    pts = spark.createDataFrame([(0, 1, -0.35, 0.0, 1.9), (0, 2, 0.05, 0.0, 1.9)], "clip int, id int, x double, y double, z double")
    got = {r.id: (r.tsdf, r.weight) for r in sf.fuse(pts, views, ["clip"], ["id"], "view", 0.4, 1.0, 0.5).collect()}
    assert got[1] == pytest.approx((0.25, 0.75 / 1.9)) and got[2] == (None, 0.0)


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_bands_grow_by_steps(spark, rounds):
    r = random.Random(rounds)
    cells = {(c, r.randrange(19), r.randrange(19), r.randrange(19)) for c in (0, 1) for _ in range(12)} | {(2, 0, 18, 7)}
    want = {(c, z + a, y + b, x + d) for c, z, y, x in cells for a in range(-rounds, rounds + 1) for b in range(-rounds, rounds + 1) for d in range(-rounds, rounds + 1)
            if abs(a) + abs(b) + abs(d) <= rounds and 0 <= z + a < 19 and 0 <= y + b < 19 and 0 <= x + d < 19}
    got = [tuple(x) for x in fold.dilate(spark.createDataFrame(sorted(cells), "clip int, iz int, iy int, ix int"), ["clip"], 19, rounds).collect()]
    assert len(got) == len(want) and set(got) == want


def test_no_group_is_lost_to_rounding(spark):
    r = random.Random(4)
    rows = [(g, r.choice([1.0, 2.0, 3.5, r.random()]), r.choice([0.1, 0.3, 1 / 3, 0.7, 1e-9, 5.0])) for g in range(3000) for _ in range(r.randint(1, 9))]
    by = {}
    for g, v, w in rows:
        by.setdefault(g, []).append((v, w))
    got = {x.g: x.m for x in median_of(spark.createDataFrame(rows, "g int, v double, w double"), ["g"], F.col("v"), "m", F.col("w")).collect()}
    assert set(got) == set(by)
    for g, pairs in by.items():
        p = 10 - int(np.floor(np.log10(max(w for _, w in pairs))))
        units = sorted((v, round(w * 10.0**p)) for v, w in pairs)
        total, upto = sum(u for _, u in units), 0
        for v, u in units:
            upto += u
            if 2 * upto >= total:
                break
        assert got[g] == v


@pytest.mark.parametrize("split", [False, True])
def test_every_good_group_gets_its_line(spark, request, split):
    if split:
        request.getfixturevalue("hot")
    r = random.Random(5)
    n = 300 if split else 3000
    rows = [(g, x, 2 * x + 1 + r.gauss(0, 0.01), r.choice([0.1, 0.3, 1 / 3])) for g in range(n) for x in [r.random() * 10 for _ in range(r.randint(6, 10) if not split else r.choice([8, 30]))]]
    d = spark.createDataFrame(rows, "g int, x double, y double, w double")
    got = fits.huber_fit(d, ["g"], F.col("x"), F.col("y"), F.col("w"), True, 5).collect()
    assert len(got) == n and all(x.slope is not None and abs(x.slope - 2) < 0.1 for x in got)


def test_fits_agree_both_ways(spark, request):
    r = random.Random(6)
    rows = [(g, i, r.random() * 4, 1 + r.random()) for g in range(12) for i in range(r.choice([10, 60]))] + [(99, i, 1.0, 2.0) for i in range(5)]
    d = spark.createDataFrame(rows, "g int, i int, x double, z double")
    run = lambda: {x.g: x for x in fits.tukey_fit(d, ["g"], ["i"], F.col("x"), F.col("z"), 4).collect()}
    whole = run()
    request.getfixturevalue("hot")
    split = run()
    assert set(whole) == set(split) == {x[0] for x in rows}
    for g in whole:
        for a, b in zip(whole[g], split[g]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-9)), (whole[g], split[g])


def flood(pixels, corners):
    left, out = set(pixels), {}
    while left:
        first = min(left)
        todo, seen = [first], {first}
        while todo:
            y, x = todo.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (corners or a == 0 or b == 0) and (y + a, x + b) in left and (y + a, x + b) not in seen:
                        seen.add((y + a, x + b))
                        todo.append((y + a, x + b))
        left -= seen
        out |= dict.fromkeys(seen, first)
    return out


@pytest.mark.parametrize("neighbours", [4, 8])
def test_pixel_regions(spark, neighbours):
    r = random.Random(neighbours)
    masks = {m: [(y, x) for y in range(14) for x in range(17) if r.random() < p] for m, p in ((1, 0.3), (2, 0.5), (3, 0.65), (None, 0.4))}
    px = spark.createDataFrame([(m, y, x) for m, ps in masks.items() for y, x in ps * 2], "m int, y int, x int")
    runs = regions.pixel_runs(px, ["m"])
    assert regions.run_links(runs, ["m"], neighbours).count() <= 2 * runs.count()
    got = {(g.m, g.y, x): (g.region_y, g.region_x) for g in regions.pixel_regions(px, ["m"], neighbours).collect() for x in range(g.x0, g.x1 + 1)}
    assert got == {(m, *p): first for m, ps in masks.items() for p, first in flood(ps, neighbours == 8).items()}


def test_nearest_point_meets_few(spark):
    r = random.Random(9)
    points = [(0, i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(400)] + [(0, 400 + i, 50 + r.random() / 1e4, 50.0) for i in range(400)] + [(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0)]
    seeds = [(0, k, r.gauss(0, 30), r.gauss(0, 30)) for k in range(150)] + [(1, 999, 1e6, -1e6), (2, 1000, 0.0, 0.0)]
    got = regions.nearest_point(spark.createDataFrame(points, "g int, id int, x double, y double"), spark.createDataFrame(seeds, "g int, seed int, x double, y double"), ["g"], "seed", ["id"])
    want = {s: min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for h, _, x, y in points if h == g) for g, s, a, b in seeds if g < 2}
    found = {x.seed: x for x in got.collect()}
    assert set(found) == set(want) and all(found[s].distance == pytest.approx(d) for s, d in want.items()) and found[999].id == 1


def test_crowded_edges_are_an_error(spark):
    d = spark.createDataFrame([(1, f) for f in range(5)] + [(2, 7), (2, 8), (3, 9)], "e int, f int")
    got = {(r.src, r.dst) for r in gr.face_neighbours(d, [], "f", ["e"]).collect()}
    assert got == {(a, b) for a in range(5) for b in range(5) if a != b} | {(7, 8), (8, 7)}
    with pytest.raises(SparkRuntimeException, match="more than 4 faces"):
        gr.face_neighbours(d, [], "f", ["e"], most=4).collect()


def test_sweeps_equal_a_loop(spark):
    r = random.Random(10)
    n, labels = 40, 4
    score = {(f, v): r.random() for f in range(n) for v in range(labels) if r.random() < 0.8 or v == 0}
    pairs = {(a, b) for a in range(n) for b in (a + 1, a + 5) if b < n and r.random() < 0.6}
    near = {f: sorted({b for a, b in pairs if a == f} | {a for a, b in pairs if b == f}) for f in range(n)}
    lab = {f: min((-score[f, v], v) for v in range(labels) if (f, v) in score)[1] for f in range(n)}
    w = 0.15 * float(np.median([score[f, lab[f]] for f in range(n)]))
    for _ in range(2):
        for f in range(n):
            lab[f] = min((-score[f, v] + w * sum(lab[g] != v for g in near[f]), v) for v in range(labels) if (f, v) in score)[1]
    s = spark.createDataFrame([(f, v, q) for (f, v), q in score.items()], "node int, label int, score double")
    e = spark.createDataFrame([(a, b) for f in near for a, b in ((f, g) for g in near[f])], "src int, dst int")
    assert {x.node: x.label for x in gr.smooth_in_order(s, e, sweeps=2).collect()} == lab


def test_large_files_are_read_by_several_tasks(spark, tmp_path):
    r, lines, want, n = random.Random(11), [], [], 0
    for k in range(4000):
        corners = r.randint(3, 5)
        for _ in range(corners):
            lines.append(f"v {n} {k} 0.5")
            n += 1
        lines.append("f " + " ".join(f"{i}/1" for i in range(-corners, 0)) if k % 2 else "f " + " ".join(str(n - corners + i + 1) for i in range(corners)))
        want += [(n - corners, n - corners + i + 1, n - corners + i + 2) for i in range(corners - 2)]
    (tmp_path / "mesh").mkdir()
    (tmp_path / "mesh" / "one.obj").write_text("# head\n" + "\r\n".join(lines) + "\n")
    frames = [{"candidate_index": i, "metrics": {"a": i / 2}, "path": f"f{i}.png", "source_frame_index": i} for i in range(3000)]
    doc = {"schema_version": "7", "frames": frames, "keyframes": frames[::100], "metadata": {"a": "b"}, "warnings": []}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "laid.json").write_text(json.dumps(doc, indent=2, sort_keys=True))
    (tmp_path / "docs" / "flat.json").write_text(json.dumps(doc))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert rd.numbered_lines(spark, str(tmp_path / "mesh")).select("block").distinct().count() > 5
        vertices, faces = rd.read_mesh_text(spark, str(tmp_path / "mesh"))
        assert sorted((v.vid, int(v.x)) for v in vertices.collect()) == [(i, i) for i in range(n)]
        assert [tuple(f)[-3:] for f in faces.orderBy("line", "part").collect()] == want
        for which, rows in (("frames", frames), ("keyframes", frames[::100])):
            got = rd.read_analysis(spark, str(tmp_path / "docs"), which).collect()
            for name in ("laid.json", "flat.json"):
                mine = sorted((g.position, g.frame.candidate_index, g.frame.path, g.frame.metrics["a"], g.schema_version) for g in got if g.clip.endswith(name))
                assert mine == [(i, x["candidate_index"], x["path"], x["metrics"]["a"], "7") for i, x in enumerate(rows)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_job_state_over_batches_is_bounded(spark, tmp_path):
    schema = "job string, event long, at timestamp, kind string, stage string, made array<struct<key:string,digest:string>>"
    row = lambda job, event, hour, kind, stage, *made: (job, event, f"2024-01-01 {hour:02d}:00:00" if hour < 24 else f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00", kind, stage, [list(m) for m in made] or None)
    batches = [
        [row("a", 1, 0, "started", "s"), row("a", 1, 0, "started", "s"), row("a", 2, 1, "completed", "s", ("m", "1"), ("n", "1")), row("b", 3, 1, "failed", "s")],
        [row("a", 2, 1, "completed", "s", ("m", "1"), ("n", "1")), row("a", 4, 2, "started", "s"), row("a", 5, 3, "completed", "s", ("m", "2")), row("a", 6, 4, "completed", "t", ("z", "9"))],
        [row("c", 7, 300, "started", "s")], [row("c", 8, 600, "started", "s")], [row("c", 9, 601, "failed", "s")],
    ]
    folder = tmp_path / "in"
    out = None
    with st.rocksdb(spark):
        for k, rows in enumerate(batches):
            d = spark.createDataFrame([r[:2] + (None,) + r[3:] for r in rows], schema)
            at = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "job string, event long, t string").distinct()
            d = d.drop("at").join(at, ["job", "event"]).withColumn("at", F.to_timestamp("t")).select("job", "event", "at", "kind", "stage", "made")
            d.coalesce(1).write.mode("append").parquet(str(folder))
            s = st.stream_job_state(spark.readStream.schema(schema).parquet(str(folder)), "job", "event", "at", "kind", "stage", "made", ["s", "t"], "1 hour", 3_600_000, 86_400_000)
            out = st.run_once(s, str(tmp_path / "out"), str(tmp_path / "state"), "update")
        got = {r.job: r for r in st.latest_per_key(out, ["job"]).collect()}
        assert (got["a"].status, got["a"].attempts, got["a"].artifacts, got["a"].events) == ("completed", [2, 0], ["m=2", "z=9"], 5)
        assert got["b"].status == "failed" and got["c"].status == "failed" and got["c"].attempts == [1, 0]  # its first start was long forgotten
        kept = spark.read.format("statestore").option("stateVarName", "job").load(str(tmp_path / "state")).select("key.job").collect()
        assert {r.job for r in kept} == {"c"}


def test_quarter_turns(spark):
    from clipledger.operators.pairs import aligned_quantile

    r, side = np.random.default_rng(12), 3
    masks = [(r.random((side, side)) > p).astype(float) for p in (0.3, 0.5, 0.5, 0.7, 0.4, 1.0, 1.0)] + [np.rot90(np.arange(9).reshape(3, 3) > 4).astype(float)]
    looks = [v / np.linalg.norm(v) for v in r.normal(size=(len(masks), 4))]

    def far(i, j):
        out = []
        for k in range(4):
            b = np.rot90(masks[j], k)
            either = ((masks[i] > 0) | (b > 0)).sum()
            s = 1 - ((masks[i] > 0) & (b > 0)).sum() / either if either else 0.0
            a = min(max(1 - float(looks[i] @ looks[j]), 0), 2)
            out.append((s + 0.15 * a, s, a, k))
        return min(out)

    d = spark.createDataFrame([(0, i, m.ravel().tolist(), a.tolist()) for i, (m, a) in enumerate(zip(masks, looks))], "g int, i int, s array<double>, a array<double>")
    got = aligned_quantile(d, ["g"], "s", "a", side, ["i"], 0.5, "m").first().m
    assert got == pytest.approx(float(np.median([far(i, j)[1] for i in range(len(masks)) for j in range(i + 1, len(masks))])))
    p = d.alias("p").crossJoin(d.alias("q")).select(F.col("p.i").alias("i"), F.col("q.i").alias("j"), F.col("p.s").alias("s"), F.col("q.s").alias("t"), F.col("p.a").alias("a"), F.col("q.a").alias("b"))
    for x in p.select("i", "j", gr.best_turn("s", "t", "a", "b", side).alias("best")).collect():
        want = far(x.i, x.j)
        assert x.best.silhouette == pytest.approx(want[1]) and x.best.appearance == pytest.approx(want[2]) and x.best.cost == pytest.approx(want[0])
        assert x.best.turn == want[3] or far(x.i, x.j)[0] == pytest.approx(x.best.cost)
