"""Queries for points, voxels, pixels and faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.operators import fold, regions
from clipledger.operators import surfaces as sf
from clipledger.plans.aggregates import LINE_ORDER, LINE_SQL
from clipledger.plans.gates import _ROT, _arr
from clipledger.plans.registry import big, parts_sql, q6, query, r6, vector_parts

col = F.col
W = H = 16


def nation_views(t, clip):
    """Nations as views: a pose from the key, a 16x16 image, a mask of the pixels their customers fall on."""
    px = t.customer.select(col("c_nationkey").alias("view"), F.floor((col("c_acctbal") + 1000) / 11001 * W).cast("int").alias("x"), ((col("c_custkey") * 7) % H).cast("int").alias("y"), F.lit(W).alias("width"), F.lit(H).alias("height"))
    masks = sf.mask_bitmaps(px, [], "view")
    n = t.nation.select(col("n_nationkey").alias("view"), clip.alias("clip"))
    k = col("view").cast("double")
    cam = n.select("clip", "view", _arr([1, 0, 0, 0, 1, 0, 0, 0, 1]).alias("rotation"), F.array(k / 50 - 0.25, k / -60 + 0.2, F.lit(4.0)).alias("translation"), F.lit(20.0).alias("focal"), F.lit(8.0).alias("cx"), F.lit(8.0).alias("cy"), F.lit(0.05).alias("k1"), F.lit(W).alias("width"), F.lit(H).alias("height"))
    return cam.join(masks, "view")


VIEWS_SQL = """mk AS (SELECT DISTINCT c_nationkey AS view, CAST(floor((c_acctbal + 1000) / 11001 * 16) AS INT) AS x, CAST((c_custkey * 7) % 16 AS INT) AS y FROM customer)"""


def proj_sql(clip_join: str) -> str:
    """Pixels u, v, depth z and inside flags of points pt(clip, id, x, y, z) in the nation views: ``inside`` by the
    exact position, ``rounded`` by the nearest pixel."""
    pixel = lambda a: f"least(greatest(round_even({a}, 0), 0), 15)"
    return f"""pj AS (SELECT pt.*, n_nationkey AS view, pt.x + n_nationkey / 50 - 0.25 AS xc, pt.y + n_nationkey / -60 + 0.2 AS yc, pt.z + 4.0 AS zc FROM pt JOIN nation ON {clip_join}),
pn AS (SELECT *, xc / CASE WHEN zc > 1e-9 THEN zc ELSE 1 END AS xn, yc / CASE WHEN zc > 1e-9 THEN zc ELSE 1 END AS yn FROM pj),
pu AS (SELECT *, 20 * xn * (1 + 0.05 * (xn*xn + yn*yn)) + 8 AS u, 20 * yn * (1 + 0.05 * (xn*xn + yn*yn)) + 8 AS v FROM pn),
pz AS (SELECT pu.*, zc > 1e-9 AND u >= 0 AND u < 16 AND v >= 0 AND v < 16 AS inside, zc > 1e-9 AND round_even(u, 0) BETWEEN 0 AND 15 AND round_even(v, 0) BETWEEN 0 AND 15 AS rounded, mk.view IS NOT NULL AS hit
  FROM pu LEFT JOIN mk ON mk.view = pu.view AND mk.x = {pixel("u")} AND mk.y = {pixel("v")})"""


@query("point_support", f"""
WITH {VIEWS_SQL}, pt AS (SELECT n_regionkey AS clip, s_suppkey AS id, s_acctbal / 10000 - 0.5 AS x, s_nationkey / 25 - 0.5 AS y, s_acctbal / 5000 - 1 AS z FROM supplier JOIN nation ON s_nationkey = n_nationkey),
{proj_sql("n_regionkey = clip")} SELECT id AS s_suppkey, count(*) FILTER (WHERE inside AND hit) AS support FROM pz GROUP BY 1""")
def point_support(t):
    p = t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey")).select(col("n_regionkey").alias("clip"), "s_suppkey", (col("s_acctbal") / 10000 - 0.5).alias("x"), (col("s_nationkey") / 25 - 0.5).alias("y"), (col("s_acctbal") / 5000 - 1).alias("z"))
    return sf.point_support(p, region_views(t), ["clip"], "s_suppkey", "view").select("s_suppkey", "support")


def region_views(t):
    """Nations as views of their region."""
    return nation_views(t, F.lit(None).cast("int")).drop("clip").join(t.nation.select(col("n_nationkey").alias("view"), col("n_regionkey").alias("clip")), "view")


_PARTS = "pt AS (SELECT 0 AS clip, p_partkey AS id, p_size / 50 - 0.5 AS x, (p_retailprice - 900) / 1000 - 0.5 AS y, p_size / 100 - 0.25 AS z FROM part)"


def part_voxels(t):
    return t.part.select(F.lit(0).alias("clip"), "p_partkey", (col("p_size") / 50 - 0.5).alias("x"), ((col("p_retailprice") - 900) / 1000 - 0.5).alias("y"), (col("p_size") / 100 - 0.25).alias("z"))


@query("vote_carve", f"""
WITH {VIEWS_SQL}, {_PARTS}, {proj_sql("clip = 0")}, s AS (SELECT id, count(*) FILTER (WHERE inside AND NOT hit) AS abstain, count(*) FILTER (WHERE NOT rounded OR NOT hit) AS reject FROM pz GROUP BY 1)
SELECT 'abstain' AS policy, id AS p_partkey, abstain AS rejections FROM s WHERE abstain <= 14 UNION ALL SELECT 'reject', id, reject FROM s WHERE reject <= 14""")
def vote_carve(t):
    views = nation_views(t, F.lit(0))
    one = lambda p: sf.carve(part_voxels(t), views, ["clip"], ["p_partkey"], "view", 14, p).select(F.lit(p).alias("policy"), "p_partkey", "rejections")
    return one("abstain").unionByName(one("reject"))


@query("carve_grid", f"""
WITH {VIEWS_SQL}, ax AS (SELECT CAST(i AS INT) AS i, -0.5 + i * CAST(1.0 / 27 AS DOUBLE) AS c FROM range(28) r(i)),
pt AS (SELECT r_regionkey AS clip, z.i AS iz, y.i AS iy, x.i AS ix, x.c AS x, y.c AS y, z.c AS z FROM region, ax z, ax y, ax x), {proj_sql("n_regionkey = clip")},
s AS (SELECT clip, iz, iy, ix, count(*) FILTER (WHERE inside AND NOT hit) AS abstain, count(*) FILTER (WHERE NOT rounded OR NOT hit) AS reject FROM pz GROUP BY ALL)
SELECT 'abstain' AS policy, clip, iz, iy, ix, abstain AS rejections FROM s WHERE abstain <= 2 UNION ALL SELECT 'reject', clip, iz, iy, ix, reject FROM s WHERE reject <= 3""")
def carve_grid(t):
    """A grid of 28 cells an edge for each region, carved by its nations' views."""
    clips, views = t.region.select(col("r_regionkey").alias("clip")), region_views(t)
    one = lambda p, k: fold.carve_grid(clips, views, ["clip"], "view", 28, -0.5, 0.5, k, p).select(F.lit(p).alias("policy"), "clip", "iz", "iy", "ix", "rejections")
    return one("abstain", 2).unionByName(one("reject", 3))


@query("weighted_fuse", f"""
WITH s AS (SELECT l_partkey, (l_extendedprice / 10000 - l_quantity / 10) / 4.0 AS sdf, l_extendedprice / 10000 AS m, l_quantity / 10 AS z, 1 - l_discount AS c FROM lineitem),
u AS (SELECT l_partkey, least(sdf, 1) AS s, CASE WHEN m > 1e-6 AND z > 1e-9 AND sdf >= -1 THEN c / z END AS w FROM s)
SELECT l_partkey, {q6("sum(w * s) / sum(w)")} AS tsdf, {q6("coalesce(sum(w), 0)")} AS weight FROM u GROUP BY 1""")
def weighted_fuse(t):
    d = sf.fuse_samples(t.lineitem, ["l_partkey"], col("l_extendedprice") / 10000, col("l_quantity") / 10, 1 - col("l_discount"), 4.0)
    return d.select("l_partkey", r6("tsdf").alias("tsdf"), r6("weight").alias("weight"))


def depth_pixels(t):
    """Pixels of the nations' depth images: where their customers fall, at a depth of their balances."""
    px = t.customer.groupBy(col("c_nationkey").alias("view"), F.floor((col("c_acctbal") + 1000) / 11001 * W).cast("int").alias("x"), ((col("c_custkey") * 7) % H).cast("int").alias("y"))
    return px.agg((3.7 + F.avg("c_acctbal") / 30000).cast("float").cast("double").alias("depth"))


_STEP = 1.0 / 19


@query("fuse", f"""
WITH oc AS (SELECT DISTINCT n_regionkey AS clip, CAST(s_suppkey % 20 AS INT) AS iz, CAST(s_suppkey * 7 % 20 AS INT) AS iy, CAST(floor((s_acctbal + 1000) / 11001 * 20) AS INT) AS ix FROM supplier JOIN nation ON s_nationkey = n_nationkey),
st AS (SELECT a.i AS a, b.i AS b, c.i AS c FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i) WHERE abs(a.i) + abs(b.i) + abs(c.i) <= 2),
bd AS (SELECT DISTINCT clip, CAST(iz + a AS INT) AS iz, CAST(iy + b AS INT) AS iy, CAST(ix + c AS INT) AS ix FROM oc, st WHERE iz + a BETWEEN 0 AND 19 AND iy + b BETWEEN 0 AND 19 AND ix + c BETWEEN 0 AND 19),
pt AS (SELECT *, -0.5 + ix * {_STEP}::DOUBLE AS x, -0.5 + iy * {_STEP}::DOUBLE AS y, -0.5 + iz * {_STEP}::DOUBLE AS z FROM bd),
dp AS (SELECT c_nationkey AS view, CAST(floor((c_acctbal + 1000) / 11001 * 16) AS INT) AS x, CAST((c_custkey * 7) % 16 AS INT) AS y, CAST(3.7 + avg(c_acctbal) / 30000 AS FLOAT)::DOUBLE AS d FROM customer GROUP BY ALL),
im AS (SELECT n_nationkey AS view, CAST(y.i AS INT) AS y, CAST(x.i AS INT) AS x, coalesce(d, 0) AS d FROM nation CROSS JOIN range(16) y(i) CROSS JOIN range(16) x(i) LEFT JOIN dp ON dp.view = n_nationkey AND dp.y = y.i AND dp.x = x.i),
nb AS (SELECT p.view, p.y, p.x, sum(q.d * sx) AS gx, sum(q.d * sy) AS gy FROM im p
  JOIN (SELECT a.i AS dy, b.i AS dx, b.i * (2 - abs(a.i)) AS sx, a.i * (2 - abs(b.i)) AS sy FROM range(-1, 2) a(i), range(-1, 2) b(i)) k ON true
  JOIN im q ON q.view = p.view AND q.y = 15 - abs(15 - abs(p.y + dy)) AND q.x = 15 - abs(15 - abs(p.x + dx)) GROUP BY ALL),
mk AS (SELECT view, y, x, CASE WHEN sqrt(gx * gx + gy * gy) > 4.0 * sqrt(3) THEN 0 ELSE d END AS d FROM nb JOIN im USING (view, y, x)), {proj_sql("n_regionkey = clip").replace("mk.view IS NOT NULL AS hit", "mk.d")},
sm AS (SELECT *, (d - zc) / {4 * _STEP}::DOUBLE AS sdf, (0.5 + view / 50) * (1 - view % 3 / 10) / greatest(zc, 1e-6) AS w FROM pz),
fu AS (SELECT clip, iz, iy, ix, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, sum(w * least(sdf, 1)) FILTER (WHERE inside AND d > 1e-6 AND sdf >= -1) AS s, coalesce(sum(w) FILTER (WHERE inside AND d > 1e-6 AND sdf >= -1), 0) AS weight FROM sm GROUP BY ALL)
SELECT clip, iz, iy, ix, {q6("s / weight")} AS tsdf, {q6("weight")} AS weight, {q6("coalesce(least(weight / 1.5, 1) * s / weight, 0) + (1 - least(weight / 1.5, 1)) * (sqrt(x*x + y*y + z*z) - 0.4)")} AS field FROM fu""")
def fuse(t):
    """The band around cells that suppliers occupy, fused from the depth images of their region's nations and mixed
    with the field of a ball."""
    occupied = t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey")).select(
        col("n_regionkey").alias("clip"), (col("s_suppkey") % 20).cast("int").alias("iz"), (col("s_suppkey") * 7 % 20).cast("int").alias("iy"), F.floor((col("s_acctbal") + 1000) / 11001 * 20).cast("int").alias("ix"))
    at = F.map_from_entries(F.collect_list(F.struct((col("y") * W + col("x")).alias("at"), "depth")))
    maps = depth_pixels(t).groupBy("view").agg(F.transform(F.sequence(F.lit(0), F.lit(W * H - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0))).alias("depth_map"))
    views = region_views(t).drop("mask").join(maps, "view", "left").withColumn("depth_map", F.coalesce("depth_map", F.array_repeat(F.lit(0.0), W * H)))
    views = views.withColumns({"depth_conf": 0.5 + col("view") / 50, "conf_map": F.array_repeat(1 - col("view") % 3 / 10, W * H)})
    d = sf.fuse_grid(occupied, views, ["clip"], "view", 20, -0.5, 0.5, 4.0, 4.0)
    d = sf.blend_fields(d, F.sqrt(col("x") * col("x") + col("y") * col("y") + col("z") * col("z")) - 0.4)
    return d.select("clip", "iz", "iy", "ix", r6("tsdf").alias("tsdf"), r6("weight").alias("weight"), r6("field").alias("field"))


_TRI = "tr AS (SELECT label, vec_id * 10 + part AS face, " + ", ".join(f"v{2 * i + 1} * 24 + 12 AS u{i}, v{2 * i + 2} * 24 + 12 AS v{i}, v{7 + i} + 2 AS z{i}" for i in range(3)) + f" FROM {parts_sql(9)})"


def triangles(t):
    e = [col("values")[i] for i in range(9)]
    cols = []
    for i in range(3):
        cols += [(e[2 * i] * 24 + 12).alias(f"u{i}"), (e[2 * i + 1] * 24 + 12).alias(f"v{i}"), (e[6 + i] + 2).alias(f"z{i}")]
    return vector_parts(t, 9).select("label", (col("vec_id") * 10 + col("part")).alias("face"), *cols, F.lit(24).alias("width"), F.lit(24).alias("height"))


def _edge(i, j):
    return f"((u{j}-u{i})*(y-v{i}) - (v{j}-v{i})*(x-u{i})) / ar"


@query("nearest_per_cell", f"""
WITH {_TRI}, a AS (SELECT *, (u1-u0)*(v2-v0) - (u2-u0)*(v1-v0) AS ar FROM tr), g AS (SELECT * FROM a, range(24) p(x), range(24) q(y) WHERE abs(ar) > 1e-12 AND x BETWEEN least(u0,u1,u2) AND greatest(u0,u1,u2) AND y BETWEEN least(v0,v1,v2) AND greatest(v0,v1,v2)),
b AS (SELECT *, {_edge(1, 2)} AS ba, {_edge(2, 0)} AS bb, {_edge(0, 1)} AS bg FROM g),
d AS (SELECT label, face, x, y, round(1 / (ba / z0 + bb / z1 + bg / z2), 9) AS depth FROM b WHERE ba >= -1e-9 AND bb >= -1e-9 AND bg >= -1e-9),
r AS (SELECT *, row_number() OVER (PARTITION BY label, x, y ORDER BY depth, face) AS rn FROM d)
SELECT label, y, x, face, {q6("depth")} AS depth FROM r WHERE rn = 1""")
def nearest_per_cell(t):
    d = sf.zbuffer(triangles(t), ["label"], "face")
    return d.select("label", big("y").alias("y"), big("x").alias("x"), "face", r6("depth").alias("depth"))


@query("visible_faces", f"""
WITH {_TRI}, a AS (SELECT *, (u1-u0)*(v2-v0) - (u2-u0)*(v1-v0) AS ar FROM tr), g AS (SELECT * FROM a, range(24) p(x), range(24) q(y) WHERE abs(ar) > 1e-12 AND x BETWEEN least(u0,u1,u2) AND greatest(u0,u1,u2) AND y BETWEEN least(v0,v1,v2) AND greatest(v0,v1,v2)),
b AS (SELECT *, {_edge(1, 2)} AS ba, {_edge(2, 0)} AS bb, {_edge(0, 1)} AS bg FROM g),
d AS (SELECT label, x, y, min(round(1 / (ba / z0 + bb / z1 + bg / z2), 9)) AS near FROM b WHERE ba >= -1e-9 AND bb >= -1e-9 AND bg >= -1e-9 GROUP BY 1, 2, 3)
SELECT a.label, face FROM a JOIN d ON a.label = d.label AND d.x = round_even((u0+u1+u2) / 3, 0) AND d.y = round_even((v0+v1+v2) / 3, 0) WHERE abs(ar) > 20 AND (z0+z1+z2) / 3 <= near + 0.02""")
def visible_faces(t):
    tri = triangles(t)
    area = F.abs((col("u1") - col("u0")) * (col("v2") - col("v0")) - (col("u2") - col("u0")) * (col("v1") - col("v0")))
    return sf.visible_faces(tri, sf.zbuffer(tri, ["label"], "face"), ["label"], "face", 0.02, area, 20.0).select("label", "face")


@query("bilinear", f"""
WITH p AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS embedding, i AS point, least(greatest(e.embedding[i + 1]::DOUBLE * 8 + 3.5, 0), 8 - 1.000001::DOUBLE) AS u, least(greatest(e.embedding[i + 2]::DOUBLE * 8 + 3.5, 0), 8 - 1.000001::DOUBLE) AS v FROM embeddings e, range(0, 63) r(i)),
c AS (SELECT *, CAST(floor(u) AS INT) AS x, CAST(floor(v) AS INT) AS y, u - floor(u) AS fu, v - floor(v) AS fv FROM p)
SELECT vec_id, point, {q6("(1-fu)*(1-fv)*embedding[y*8 + x + 1] + fu*(1-fv)*embedding[y*8 + least(x+1, 7) + 1] + (1-fu)*fv*embedding[least(y+1, 7)*8 + x + 1] + fu*fv*embedding[least(y+1, 7)*8 + least(x+1, 7) + 1]")} AS value FROM c""")
def bilinear(t):
    """Each embedding as an image of 8 by 8, sampled at positions that neighbouring components name."""
    cells = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "value"))
    image = cells.select("vec_id", F.expr("i div 8").alias("y"), (col("i") % 8).alias("x"), col("value").cast("double").alias("value"))
    at = t.embeddings.select("vec_id", F.posexplode(F.arrays_zip(F.slice("embedding", 1, 63).alias("a"), F.slice("embedding", 2, 63).alias("b"))).alias("point", "z"))
    points = at.select("vec_id", big("point").alias("point"), (col("z.a").cast("double") * 8 + 3.5).alias("u"), (col("z.b").cast("double") * 8 + 3.5).alias("v"))
    return sf.bilinear(points, image, ["vec_id"], "point", 8, 8).select("vec_id", "point", r6("value").alias("value"))


@query("face_view_score", f"""
WITH c AS (SELECT l_returnflag AS g, l_partkey AS f, l_suppkey AS s, l_orderkey AS o, l_linenumber AS n, l_linestatus = 'O' AS vis, l_extendedprice / 1000 AS area, l_discount * 10 AS fr, l_linenumber <= 5 AS ins, l_tax < 0.07 AS im, l_quantity AS bd FROM lineitem),
r AS (SELECT *, area * least(1, bd / (3 * 8.0)) * fr AS q, row_number() OVER (PARTITION BY g, f ORDER BY area * least(1, bd / (3 * 8.0)) * fr DESC, s, o, n) AS slot FROM c WHERE vis AND fr > 0.2 AND ins AND im AND bd > 8),
k AS (SELECT g, count(*) AS kept, sum(q) AS total FROM r WHERE slot <= 8 GROUP BY 1),
t AS (SELECT g, count(*) AS candidates, count(*) FILTER (WHERE vis) AS visible, count(*) FILTER (WHERE fr > 0.2) AS frontal, count(*) FILTER (WHERE ins) AS inside, count(*) FILTER (WHERE im) AS in_mask, count(*) FILTER (WHERE bd > 8) AS clear_of_boundary, count(*) FILTER (WHERE vis AND fr > 0.2 AND ins AND im AND bd > 8) AS passed FROM c GROUP BY 1)
SELECT g AS l_returnflag, candidates, visible, frontal, inside, in_mask, clear_of_boundary, passed, kept, round(total, 4) + 0.0 AS quality FROM t JOIN k USING (g)""")
def face_view_score(t):
    c = t.lineitem.withColumn("view", F.struct("l_suppkey", "l_orderkey", "l_linenumber"))
    best, stats = sf.score_face_views(c, ["l_returnflag"], "l_partkey", "view", visible=col("l_linestatus") == "O", area=col("l_extendedprice") / 1000, frontality=col("l_discount") * 10, inside=col("l_linenumber") <= 5, boundary=col("l_quantity"), in_mask=col("l_tax") < 0.07, min_frontality=0.2, min_boundary=8.0)
    kept = best.groupBy("l_returnflag").agg(F.count("*").alias("kept"), (F.round(F.sum("quality"), 4) + 0.0).alias("quality"))
    return stats.join(kept, "l_returnflag").select("l_returnflag", "candidates", "visible", "frontal", "inside", "in_mask", "clear_of_boundary", "passed", "kept", "quality")


@query("best_source", f"""
WITH s AS (SELECT l_partkey, l_suppkey, l_extendedprice AS colour, round(0.45 * least(greatest(l_quantity / 50, 0), 1) + 0.22 * least(greatest(l_linenumber * 6 / 32.0, 0), 1) + 0.16 * (1 - l_discount) + 0.17 * l_tax * 10 + CASE WHEN l_returnflag = 'R' THEN 0.22 ELSE 0 END, 9) AS sc FROM lineitem WHERE l_quantity / 50 >= 0.12),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY sc DESC, l_suppkey, colour) AS rn FROM s)
SELECT l_suppkey, count(*) AS texels, {q6("sum(sc)")} AS total_score, {q6("avg(colour)")} AS mean_colour FROM r WHERE rn = 1 GROUP BY 1""")
def best_source(t):
    d = sf.best_source(t.lineitem.withColumn("colour", col("l_extendedprice")), ["l_partkey"], "l_suppkey", facing=col("l_quantity") / 50, boundary=col("l_linenumber") * 6, confidence=1 - col("l_discount"), sharpness=col("l_tax") * 10, preferred=col("l_returnflag") == "R", keep=["colour"])
    return d.groupBy("l_suppkey").agg(F.count("*").alias("texels"), r6(F.sum("score")).alias("total_score"), r6(F.avg("colour")).alias("mean_colour"))


@query("edge_multiplicity", """
WITH f AS (SELECT l_returnflag AS m, l_suppkey AS v0, 10000000 + l_partkey AS v1, 100000000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS v2 FROM lineitem),
e AS (SELECT m, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (SELECT m, v0 AS a, v1 AS b FROM f UNION ALL SELECT m, v1, v2 FROM f UNION ALL SELECT m, v2, v0 FROM f) GROUP BY 1, 2, 3),
s AS (SELECT m, count(*) AS edges, count(*) FILTER (WHERE n = 1) AS boundary_edges, count(*) FILTER (WHERE n > 2) AS non_manifold_edges FROM e GROUP BY 1),
v AS (SELECT m, count(*) AS vertices FROM (SELECT m, v0 FROM f UNION SELECT m, v1 FROM f UNION SELECT m, v2 FROM f) GROUP BY 1), c AS (SELECT m, count(*) AS faces FROM f GROUP BY 1)
SELECT m AS l_returnflag, edges, boundary_edges, non_manifold_edges, faces, vertices, vertices - edges + faces AS euler FROM s JOIN v USING (m) JOIN c USING (m)""")
def edge_multiplicity(t):
    f = t.lineitem.select("l_returnflag", col("l_suppkey").alias("v0"), (10000000 + col("l_partkey")).alias("v1"), (100000000 + col("l_linenumber") * 100 + big("l_quantity")).alias("v2"))
    return sf.topology(f, ["l_returnflag"]).select("l_returnflag", "edges", "boundary_edges", "non_manifold_edges", "faces", "vertices", "euler")


_N = ["(qy-py)*(rz-pz) - (qz-pz)*(ry-py)", "(qz-pz)*(rx-px) - (qx-px)*(rz-pz)", "(qx-px)*(ry-py) - (qy-py)*(rx-px)"]


@query("face_geometry", f"""
WITH f AS (SELECT l_suppkey, l_quantity / 10 AS px, l_discount * 10 AS py, l_tax * 10 AS pz, l_linenumber / 3.0::DOUBLE AS qx, l_quantity / 20 AS qy, l_discount * 20 AS qz, l_tax * 30 AS rx, l_linenumber / 2.0::DOUBLE AS ry, l_quantity / 30 AS rz FROM lineitem),
n AS (SELECT *, {_N[0]} AS nx, {_N[1]} AS ny, {_N[2]} AS nz FROM f)
SELECT l_suppkey, {q6("sum(sqrt(nx*nx + ny*ny + nz*nz) / 2)")} AS area, {q6("avg((px + qx + rx) / 3)")} AS mean_cx, {q6("avg(coalesce(nz / nullif(sqrt(nx*nx + ny*ny + nz*nz), 0), 0))")} AS mean_nz,
  {q6("sum((px * (qy*rz - qz*ry) + py * (qz*rx - qx*rz) + pz * (qx*ry - qy*rx)) / 6)")} AS volume FROM n GROUP BY 1""")
def face_geometry(t):
    q, d, x, n = col("l_quantity"), col("l_discount"), col("l_tax"), col("l_linenumber")
    f = t.lineitem.select("l_suppkey", F.array(q / 10, d * 10, x * 10).alias("p"), F.array(n / 3.0, q / 20, d * 20).alias("q"), F.array(x * 30, n / 2.0, q / 30).alias("r"))
    g = sf.face_geometry(f)
    return g.groupBy("l_suppkey").agg(r6(F.sum("area")).alias("area"), r6(F.avg(col("centroid")[0])).alias("mean_cx"), r6(F.avg(col("normal")[2])).alias("mean_nz"), r6(F.sum("volume")).alias("volume"))


@query("profile_stats", f"""
WITH px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings) WHERE v > 0),
b AS (SELECT vec_id, count(*) AS n, sum((x=0)::INT + (x=7)::INT + (y=0)::INT + (y=7)::INT) AS ed, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS mx, avg(y) AS my FROM px GROUP BY 1),
rim AS (SELECT p.vec_id, sqrt((x-mx)*(x-mx) + (y-my)*(y-my)) AS r FROM px p JOIN b USING (vec_id) WHERE (SELECT count(*) FROM px q WHERE q.vec_id = p.vec_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1) < 4),
rd AS (SELECT vec_id, stddev_pop(r) / greatest(avg(r), 1e-9) AS rcv FROM rim GROUP BY 1),
s1 AS (SELECT p.vec_id, count(*) AS i FROM px p JOIN b USING (vec_id) JOIN px q ON q.vec_id = p.vec_id AND q.x = x0 + x1 - p.x AND q.y = p.y GROUP BY 1),
s2 AS (SELECT p.vec_id, count(*) AS i FROM px p JOIN b USING (vec_id) JOIN px q ON q.vec_id = p.vec_id AND q.x = p.x AND q.y = y0 + y1 - p.y GROUP BY 1),
s3 AS (SELECT p.vec_id, count(*) AS i FROM px p JOIN b USING (vec_id) JOIN px q ON q.vec_id = p.vec_id AND q.x = x0 + x1 - p.x AND q.y = y0 + y1 - p.y GROUP BY 1),
w AS (SELECT b.vec_id, yy - y0 AS p, y1 - y0 + 1 AS k, (SELECT count(*) FROM px WHERE px.vec_id = b.vec_id AND px.y = yy)::DOUBLE AS c FROM b, range(8) r(yy) WHERE yy BETWEEN y0 AND y1),
pf AS (SELECT vec_id, avg(c) FILTER (WHERE p < greatest(1, round_even(k * 0.2, 0))) AS tp, avg(c) FILTER (WHERE p >= k - greatest(1, round_even(k * 0.2, 0))) AS bt,
  avg(c) FILTER (WHERE p >= round_even(k * 0.4, 0) AND p < greatest(round_even(k * 0.4, 0) + 1, round_even(k * 0.6, 0))) AS md, stddev_pop(c) / greatest(avg(c), 1) AS pcv FROM w GROUP BY 1)
SELECT vec_id, {q6("n / 64")} AS area_fraction, {q6("ed / 32")} AS border_touch, {q6("least(least(tp, bt) / greatest(md, 1), 1.5)")} AS end_ratio, {q6("least(abs(tp - bt) / greatest(tp, bt, 1), 1)")} AS end_asymmetry,
  {q6("least(pcv, 2)")} AS profile_cv, {q6("least(rcv, 2)")} AS radial_cv, {q6("coalesce(s1.i, 0) / (2 * n - coalesce(s1.i, 0))")} AS symmetry_lr, {q6("coalesce(s2.i, 0) / (2 * n - coalesce(s2.i, 0))")} AS symmetry_tb, {q6("coalesce(s3.i, 0) / (2 * n - coalesce(s3.i, 0))")} AS symmetry_180
FROM b JOIN rd USING (vec_id) JOIN pf USING (vec_id) LEFT JOIN s1 USING (vec_id) LEFT JOIN s2 USING (vec_id) LEFT JOIN s3 USING (vec_id)""")
def profile_stats(t):
    px = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v")).where("v > 0").select("vec_id", F.expr("i div 8").alias("y"), (col("i") % 8).alias("x"))
    d = sf.silhouette_stats(px, ["vec_id"], F.lit(8), F.lit(8))
    return d.select("vec_id", *[r6(c).alias(c) for c in ("area_fraction", "border_touch", "end_ratio", "end_asymmetry", "profile_cv", "radial_cv", "symmetry_lr", "symmetry_tb", "symmetry_180")])


@query("reproject_classify", f"""
WITH px AS (SELECT c_nationkey AS view, CAST(floor((c_acctbal + 1000) / 11001 * 16) AS INT) AS x, CAST((c_custkey * 7) % 16 AS INT) AS y, 3 + avg(c_acctbal) / 30000 AS depth, count(*) > 1 OR max(c_acctbal) > 3000 AS stable FROM customer GROUP BY 1, 2, 3),
pr AS (SELECT a.n_nationkey AS va, b.n_nationkey AS vb FROM nation a JOIN nation b ON b.n_nationkey - a.n_nationkey IN (1, 2, 5)),
wy AS (SELECT va, vb, va AS src, vb AS dst, 'forward' AS way FROM pr UNION ALL SELECT va, vb, vb, va, 'backward' FROM pr),
j AS (SELECT wy.*, x AS px, y AS py, depth AS z, (x - 8.0) / 20 AS xn, (y - 8.0) / 20 AS yn FROM px JOIN wy ON view = src WHERE depth > 1e-9 AND stable),
c AS (SELECT *, xn * z - (src / 50 - 0.25) + (dst / 50 - 0.25) AS xc, yn * z - (src / -60 + 0.2) + (dst / -60 + 0.2) AS yc FROM j),
q AS (SELECT *, 20 * (xc / z) + 8 AS u, 20 * (yc / z) + 8 AS v, u >= 0 AND u < 15 AND v >= 0 AND v < 15 AS ins FROM c),
g AS (SELECT q.*, coalesce(d0.depth, 0) * (1 - (u - floor(u))) + coalesce(d1.depth, 0) * (u - floor(u)) AS tp, coalesce(d2.depth, 0) * (1 - (u - floor(u))) + coalesce(d3.depth, 0) * (u - floor(u)) AS bt, t.view IS NOT NULL AS msk, coalesce(t.stable, false) AS st
  FROM q LEFT JOIN px d0 ON d0.view = dst AND d0.x = floor(u) AND d0.y = floor(v) LEFT JOIN px d1 ON d1.view = dst AND d1.x = floor(u) + 1 AND d1.y = floor(v) LEFT JOIN px d2 ON d2.view = dst AND d2.x = floor(u) AND d2.y = floor(v) + 1
  LEFT JOIN px d3 ON d3.view = dst AND d3.x = floor(u) + 1 AND d3.y = floor(v) + 1 LEFT JOIN px t ON t.view = dst AND t.x = round_even(u, 0) AND t.y = round_even(v, 0)),
h AS (SELECT *, tp * (1 - (v - floor(v))) + bt * (v - floor(v)) AS td FROM g),
k AS (SELECT *, CASE WHEN NOT ins THEN 'outside' WHEN NOT msk THEN 'contradiction' WHEN NOT st OR td <= 1e-9 THEN 'unavailable' WHEN z < td - 0.09 THEN 'contradiction' WHEN z > td + 0.09 THEN 'occluded' ELSE 'match' END AS kind,
  CASE WHEN kind = 'match' OR (kind = 'contradiction' AND ins AND msk) THEN abs(z - td) / greatest(td, 1e-9) END AS err FROM h)
SELECT va AS view_a, vb AS view_b, count(*) FILTER (WHERE kind = 'match') AS matches, count(*) FILTER (WHERE kind = 'contradiction') AS contradictions, count(*) FILTER (WHERE kind = 'occluded') AS occluded,
  count(*) FILTER (WHERE kind = 'unavailable') AS unavailable, count(*) FILTER (WHERE kind = 'outside') AS outside, count(*) FILTER (WHERE way = 'forward' AND kind IN ('match', 'contradiction')) AS forward, count(*) FILTER (WHERE way = 'backward' AND kind = 'occluded') AS backward_occluded,
  {q6("count(*) FILTER (WHERE kind = 'match') / nullif(count(*) FILTER (WHERE kind IN ('match', 'contradiction')), 0)")} AS consistency, {q6("count(*) FILTER (WHERE kind IN ('match', 'contradiction')) / count(*)")} AS coverage,
  {q6("median(err)")} AS median_error, {q6("median(err) FILTER (WHERE way = 'forward')")} AS forward_median_error FROM k GROUP BY 1, 2""")
def reproject_classify(t):
    """Nations one, two and five keys apart as view pairs."""
    px = t.customer.groupBy(F.lit(0).alias("clip"), col("c_nationkey").alias("view"), F.floor((col("c_acctbal") + 1000) / 11001 * W).cast("int").alias("x"), ((col("c_custkey") * 7) % H).cast("int").alias("y"))
    px = px.agg((3 + F.avg("c_acctbal") / 30000).alias("depth"), ((F.count("*") > 1) | (F.max("c_acctbal") > 3000)).alias("stable")).withColumn("in_mask", F.lit(True))
    n = t.nation.select(F.lit(0).alias("clip"), col("n_nationkey").alias("view_a"))
    pairs = n.withColumn("view_b", F.explode(F.array(*[col("view_a") + k for k in (1, 2, 5)]))).join(t.nation.select(col("n_nationkey").alias("view_b")), "view_b", "left_semi")
    views = nation_views(t, F.lit(0)).drop("mask").withColumn("k1", F.lit(0.0))
    d = sf.reproject_pairs(pairs, px, views, ["clip"], F.lit(0.09))
    names = ["consistency", "coverage", "median_error", "forward_median_error"]
    return d.select("view_a", "view_b", "matches", "contradictions", "occluded", "unavailable", "outside", "forward", "backward_occluded", *[r6(c).alias(c) for c in names])


_M = {(i, j): f"sum({1 if i == j else 0} - d{i}*d{j})" for i in range(3) for j in range(i, 3)}


def _m(i, j):
    return f"m{min(i, j)}{max(i, j)}"


def _det(cell):
    return f"({cell(0, 0)}*({cell(1, 1)}*{cell(2, 2)} - {cell(1, 2)}*{cell(2, 1)}) - {cell(0, 1)}*({cell(1, 0)}*{cell(2, 2)} - {cell(1, 2)}*{cell(2, 0)}) + {cell(0, 2)}*({cell(1, 0)}*{cell(2, 1)} - {cell(1, 1)}*{cell(2, 0)}))"


@query("look_at", f"""
WITH e AS (SELECT label, {", ".join(f"v{i + 1} AS c{i}" for i in range(3))}, {", ".join(f"v{i + 4} AS g{i}" for i in range(3))} FROM {parts_sql(6)}),
n AS (SELECT label, c0, c1, c2, {", ".join(f"g{i} / sqrt(g0*g0 + g1*g1 + g2*g2) AS d{i}" for i in range(3))} FROM e),
s AS (SELECT label, {", ".join(f"{v} AS m{i}{j}" for (i, j), v in _M.items())}, {", ".join("sum(" + " + ".join(f"({1 if i == j else 0} - d{i}*d{j})*c{j}" for j in range(3)) + f") AS b{i}" for i in range(3))} FROM n GROUP BY 1)
SELECT label, {", ".join(q6(_det(lambda i, j, k=k: f"b{i}" if j == k else _m(i, j)) + " / " + _det(_m)) + f" AS {a}" for k, a in enumerate("xyz"))} FROM s""")
def look_at(t):
    e = vector_parts(t, 6).select("label", F.slice("values", 1, 3).alias("c"), F.slice("values", 4, 3).alias("d"))
    return sf.look_at(e, ["label"], "c", "d").select("label", *[r6(c).alias(c) for c in "xyz"])


_REGIONS = f"""{VIEWS_SQL}, k AS (SELECT * FROM (VALUES (4), (8)) t(k)),
reach AS (SELECT k, view, y, x, y AS ty, x AS tx FROM mk, k UNION SELECT r.k, r.view, r.y, r.x, p.y, p.x FROM reach r JOIN mk p ON p.view = r.view AND abs(p.y - r.ty) <= 1 AND abs(p.x - r.tx) <= 1 AND (r.k = 8 OR abs(p.y - r.ty) + abs(p.x - r.tx) <= 1)),
lab AS (SELECT k, view, y, x, min(ty * 100 + tx) // 100 AS region_y, min(ty * 100 + tx) % 100 AS region_x FROM reach GROUP BY 1, 2, 3, 4)"""


def mask_pixels(t):
    """Pixels of the nations' masks, once for 4 and once for 8 neighbours."""
    return t.customer.select(big("c_nationkey").alias("view"), ((col("c_custkey") * 7) % H).cast("int").alias("y"), F.floor((col("c_acctbal") + 1000) / 11001 * W).cast("int").alias("x"))


def _mask_regions(t):
    one = lambda k: regions.pixel_regions(mask_pixels(t), ["view"], k).withColumn("k", F.lit(k))
    return one(4).unionByName(one(8))


@query("pixel_regions", f"""
WITH RECURSIVE {_REGIONS}, s AS (SELECT k, view, region_y, region_x, count(*) AS area, min(y) AS top, max(y) AS bottom, min(x) AS "left", max(x) AS "right" FROM lab GROUP BY 1, 2, 3, 4)
SELECT CAST(k AS INT) AS k, CAST(view AS BIGINT) AS view, CAST(region_y AS INT) AS region_y, CAST(region_x AS INT) AS region_x, area, top, bottom, "left", "right", count(*) OVER w AS regions, {q6("max(area) OVER w / sum(area) OVER w")} AS dominance,
  row_number() OVER (PARTITION BY k, view ORDER BY area DESC, region_y, region_x) = 1 AS largest FROM s WINDOW w AS (PARTITION BY k, view)""")
def pixel_regions(t):
    d = regions.region_stats(_mask_regions(t), ["k", "view"])
    return d.select("k", "view", "region_y", "region_x", "area", "top", "bottom", "left", "right", "regions", r6("dominance").alias("dominance"), "largest")


@query("region_seed", f"""
WITH RECURSIVE {_REGIONS}, sd AS (SELECT DISTINCT s_nationkey AS view, s_suppkey AS seed, CAST(s_suppkey % 16 AS INT) AS sy, CAST(floor((s_acctbal + 1000) / 11001 * 16) AS INT) AS sx FROM supplier),
c AS (SELECT l.*, seed, sqrt((y - sy) * (y - sy) + (x - sx) * (x - sx)) AS d FROM lab l JOIN sd ON sd.view = l.view), r AS (SELECT *, row_number() OVER (PARTITION BY k, seed ORDER BY d, y, x) AS rn FROM c)
SELECT CAST(k AS INT) AS k, seed AS s_suppkey, CAST(region_y AS INT) AS region_y, CAST(region_x AS INT) AS region_x, {q6("d")} AS distance FROM r WHERE rn = 1""")
def region_seed(t):
    """Suppliers as seeds in the masks of their nations."""
    seeds = t.supplier.select(big("s_nationkey").alias("view"), "s_suppkey", (col("s_suppkey") % 16).cast("int").alias("y"), F.floor((col("s_acctbal") + 1000) / 11001 * 16).cast("int").alias("x"))
    seeds = seeds.withColumn("k", F.explode(F.array(F.lit(4), F.lit(8))))
    d = regions.region_of_seed(_mask_regions(t), seeds, ["k", "view"], "s_suppkey")
    return d.select("k", "s_suppkey", "region_y", "region_x", r6("distance").alias("distance"))
