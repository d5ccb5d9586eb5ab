"""Queries for joins between views, tracks and sources, and for robust fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.operators import fits, joins as jn, selection as sel, splits as sp
from clipledger.operators.regions import nearest_point
from clipledger.plans.aggregates import LINE_ORDER, LINE_SQL
from clipledger.plans.gates import _ROT, _arr
from clipledger.plans.registry import big, codes_sql, joined, parts_sql, q6, query, r6, vector_parts
from clipledger.plans.windows import FRAMES, frames

col = F.col


def order_views(t):
    """Orders as views with a unit direction, parts as shared tokens, order status as the clip."""
    x = [col("o_totalprice") / 400000, F.month("o_orderdate") / 12, F.lit(0.3)]
    n = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    views = t.orders.select("o_orderstatus", "o_orderkey", F.array(*[v / n for v in x]).alias("dir"))
    tokens = t.lineitem.select(col("l_orderkey").alias("o_orderkey"), "l_partkey").join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return jn.view_pairs(views, tokens, ["o_orderstatus"], "o_orderkey", "dir", "l_partkey", 8.0, 2)


VIEW_PAIRS = """
vx AS (SELECT o_orderstatus AS st, o_orderkey AS v, o_totalprice / 400000 AS a, month(o_orderdate) / 12 AS b, 0.3 AS c FROM orders),
vd AS (SELECT st, v, a / sqrt(a*a + b*b + c*c) AS a, b / sqrt(a*a + b*b + c*c) AS b, c / sqrt(a*a + b*b + c*c) AS c FROM vx),
tk AS (SELECT DISTINCT o_orderstatus AS st, l_orderkey AS v, l_partkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sh AS (SELECT x.st, x.v AS va, y.v AS vb, count(*) AS shared FROM tk x JOIN tk y ON x.st = y.st AND x.t = y.t AND x.v < y.v GROUP BY 1, 2, 3 HAVING count(*) >= 2),
an AS (SELECT sh.*, degrees(acos(least(greatest(p.a*q.a + p.b*q.b + p.c*q.c, -1), 1))) AS angle FROM sh JOIN vd p ON p.v = va JOIN vd q ON q.v = vb),
vp AS (SELECT *, (angle >= 15)::INT + (angle >= 35)::INT + (angle >= 65)::INT + (angle >= 100)::INT + (angle >= 140)::INT AS bin FROM an WHERE angle >= 8)"""


@query("view_pairs", f"WITH {VIEW_PAIRS} SELECT st AS o_orderstatus, va AS view_a, vb AS view_b, shared, {q6('angle')} AS angle, bin AS angle_bin FROM vp")
def view_pairs(t):
    return order_views(t).select("o_orderstatus", "view_a", "view_b", "shared", r6("angle").alias("angle"), "angle_bin")


@query("balanced_pairs", f"""
WITH RECURSIVE {VIEW_PAIRS},
p AS (SELECT st, va, vb, bin, round(abs(angle - list_extract([7.5, 25.0, 50.0, 82.5, 120.0, 160.0000005], bin + 1)), 9) AS off, row_number() OVER (PARTITION BY st ORDER BY va, vb) AS id FROM vp),
s AS (SELECT st, 0 AS r, CAST([] AS BIGINT[]) AS picked, CAST([] AS BIGINT[]) AS used, -1 AS last FROM p GROUP BY st
  UNION ALL
  SELECT st, r + 1, list_append(picked, id), list_append(list_append(used, va), vb), bin FROM (
    SELECT s.st, s.r, s.picked, s.used, p.id, p.va, p.vb, p.bin, row_number() OVER (PARTITION BY s.st ORDER BY p.bin <= s.last, p.bin, list_contains(s.used, p.va)::INT + list_contains(s.used, p.vb)::INT, p.off, p.va, p.vb) AS rn
    FROM s JOIN p ON p.st = s.st AND NOT list_contains(s.picked, p.id) WHERE s.r < 24) WHERE rn = 1)
SELECT p.st AS o_orderstatus, va AS view_a, vb AS view_b, bin AS angle_bin, CAST(list_position(picked, id) - 1 AS BIGINT) AS pick FROM (SELECT st, arg_max(picked, r) AS picked FROM s GROUP BY 1) JOIN p USING (st) WHERE list_contains(picked, id)""")
def balanced_pairs(t):
    d = sel.balanced_pairs(order_views(t), ["o_orderstatus"], "angle_bin", "angle", jn.bin_middle(col("angle_bin")), "view_a", "view_b")
    return d.select("o_orderstatus", "view_a", "view_b", "angle_bin", big("pick").alias("pick"))


@query("loop_pairs", f"""
WITH {FRAMES}, a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i FROM fr), k AS (SELECT * FROM a WHERE i % 5 = 0)
SELECT x.user_id, x.event_id AS anchor, arg_min(y.event_id, y.i) AS first_partner, arg_max(y.event_id, y.i) AS last_partner, count(*) AS partners FROM k x JOIN k y ON x.user_id = y.user_id AND y.i - x.i > 12 GROUP BY 1, 2""")
def loop_pairs(t):
    return jn.loop_ranges(frames(t), ["user_id"], ["us", "event_id"], "event_id", 12, 5)


@query("track_evidence", f"""
WITH pt AS (SELECT p_partkey, p_size / 10 AS x, p_retailprice / 1000 AS y, 1.0 AS z FROM part WHERE p_size >= 3)
SELECT l_suppkey, count(*) AS observations, {q6("avg(0.48*x + 0.64*y + 0.6*z + s_acctbal / 2000)")} AS mean_z FROM lineitem JOIN pt ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE s_acctbal > 0 AND 0.48*x + 0.64*y + 0.6*z + s_acctbal / 2000 > 0 GROUP BY 1""")
def track_evidence(t):
    p = t.part.select(F.lit(0).alias("clip"), "p_partkey", (col("p_size") / 10).alias("x"), (col("p_retailprice") / 1000).alias("y"), F.lit(1.0).alias("z"), col("p_size").alias("track_length"))
    o = t.lineitem.select(F.lit(0).alias("clip"), col("l_partkey").alias("p_partkey"), "l_suppkey")
    v = t.supplier.where("s_acctbal > 0").select(F.lit(0).alias("clip"), col("s_suppkey").alias("l_suppkey"), _arr(_ROT).alias("rotation"), F.array(F.lit(0.0), F.lit(0.0), col("s_acctbal") / 2000).alias("translation"))
    d = jn.track_evidence(p, o, v, ["clip"], "p_partkey", "l_suppkey")
    return d.groupBy("l_suppkey").agg(F.count("*").alias("observations"), r6(F.avg("z_camera")).alias("mean_z"))


_CELLS = "c AS (SELECT l_partkey, l_linenumber, l_returnflag AS src, avg(l_extendedprice) AS d, min(1 - l_discount) AS conf FROM lineitem GROUP BY 1, 2, 3)"


def depth_cells(t):
    return t.lineitem.groupBy("l_partkey", "l_linenumber", col("l_returnflag").alias("src")).agg(F.avg("l_extendedprice").alias("d"), F.min(1 - col("l_discount")).alias("conf"))


@query("consensus", f"""
WITH {_CELLS}, g AS (SELECT l_partkey, l_linenumber, count(*) AS k, min(d) AS lo, max(d) AS hi, quantile_cont(d, 0.5) AS med, min(conf) AS conf FROM c WHERE d > 0 GROUP BY 1, 2)
SELECT l_partkey, l_linenumber, k = 3 AND (hi - lo) / med <= 0.5 AS agreed, {q6("CASE WHEN k = 3 AND (hi - lo) / med <= 0.5 THEN med ELSE 0 END")} AS value, {q6("CASE WHEN k = 3 AND (hi - lo) / med <= 0.5 THEN conf ELSE 0 END")} AS confidence FROM g""")
def consensus(t):
    d = jn.consensus(depth_cells(t), ["l_partkey", "l_linenumber"], "src", "d", "conf", 3, 0.5)
    return d.select("l_partkey", "l_linenumber", "agreed", r6("value").alias("value"), r6("confidence").alias("confidence"))


_DIFFS = f"""{_CELLS}, j AS (SELECT x.l_partkey, x.src AS a, y.src AS b, 2 * abs(x.d - y.d) / (x.d + y.d) AS r FROM c x JOIN c y USING (l_partkey, l_linenumber) WHERE x.src < y.src AND x.d > 0 AND y.d > 0),
df AS (SELECT l_partkey, a, b, count(*) AS overlap, quantile_cont(r, 0.5) AS med FROM j GROUP BY 1, 2, 3)"""


@query("source_differences", f"WITH {_DIFFS} SELECT l_partkey, a, b, overlap, {q6('med')} AS median_difference FROM df")
def source_differences(t):
    d = jn.source_differences(depth_cells(t), ["l_partkey"], ["l_linenumber"], "src", "d")
    return d.select("l_partkey", "a", "b", "overlap", r6("median_difference").alias("median_difference"))


@query("arbitrate", f"""
WITH {_DIFFS}, e AS (SELECT l_partkey, l_returnflag AS src, count(*) >= 4 AS ok, round(avg(l_discount) * 10, 9) AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, src) AS rn FROM e WHERE ok),
g AS (SELECT l_partkey, count(*) AS n, max(score) FILTER (WHERE rn = 1) AS s1, max(score) FILTER (WHERE rn = 2) AS s2, max(src) FILTER (WHERE rn = 1) AS best FROM r GROUP BY 1),
k AS (SELECT df.l_partkey, count(*) AS oks FROM df JOIN r x ON x.l_partkey = df.l_partkey AND x.src = a JOIN r y ON y.l_partkey = df.l_partkey AND y.src = b WHERE overlap >= 2 AND med <= 0.8 GROUP BY 1),
z AS (SELECT DISTINCT l_partkey FROM e)
SELECT l_partkey, coalesce(n, 0) AS passing, CASE WHEN coalesce(n, 0) = 0 THEN 'reject' WHEN n = 1 OR s1 - s2 >= 0.08 THEN 'selected' WHEN coalesce(oks, 0) = n * (n - 1) / 2 THEN 'consensus' ELSE 'reject' END AS decision,
  CASE WHEN coalesce(n, 0) = 0 THEN 'no_backend_passed_independent_evidence' WHEN n = 1 THEN 'only_backend_to_pass_independent_evidence' WHEN s1 - s2 >= 0.08 THEN 'material_independent_evidence_margin'
  WHEN coalesce(oks, 0) = n * (n - 1) / 2 THEN 'no_material_winner_but_metric_depths_agree' ELSE 'ambiguous_backend_disagreement' END AS reason,
  CASE WHEN n = 1 OR s1 - s2 >= 0.08 THEN best END AS selected FROM z LEFT JOIN g USING (l_partkey) LEFT JOIN k USING (l_partkey)""")
def arbitrate(t):
    e = t.lineitem.groupBy("l_partkey", col("l_returnflag").alias("backend")).agg((F.count("*") >= 4).alias("accepted"), F.round(F.avg("l_discount") * 10, 9).alias("score"))
    diffs = jn.source_differences(depth_cells(t), ["l_partkey"], ["l_linenumber"], "src", "d")
    return fits.select_backend(e, diffs, ["l_partkey"], agree=0.8, pixels=2).select("l_partkey", "passing", "decision", "reason", "selected")


@query("nearest_seed", f"""
WITH v AS (SELECT label, vec_id * 100 + part AS piece, v1 AS x, v2 AS y, v3 AS z FROM {parts_sql(3)}), s AS (SELECT label, avg(x) AS sx, avg(y) AS sy FROM v GROUP BY 1),
d AS (SELECT v.label, piece, sqrt((x-sx)*(x-sx) + (y-sy)*(y-sy)) AS d, z FROM v JOIN s USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, z DESC, piece) AS rn FROM d)
SELECT label, piece, {q6("d")} AS distance FROM r WHERE rn = 1""")
def nearest_seed(t):
    v = vector_parts(t, 3).select("label", (col("vec_id") * 100 + col("part")).alias("piece"), *[col("values")[i].alias(c) for i, c in enumerate("xyz")])
    s = v.groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("seed", col("label"))
    d = nearest_point(v.withColumn("back", -col("z")), s, ["label"], "seed", ["back", "piece"])
    return d.select("label", "piece", r6("distance").alias("distance"))


@query("pair_priority", """
WITH f AS (SELECT p.page_id, k.pr, k.key FROM pages p, LATERAL (VALUES (0, 'doc' || p.page_id * 7 || '_mask.png'), (1, 'doc' || p.page_id * 3 || '.png'), (2, 'doc' || p.page_id)) k(pr, key)),
a AS (SELECT DISTINCT CASE source WHEN 'src0' THEN 'doc' || doc_id || '_mask.png' WHEN 'src1' THEN 'doc' || doc_id || '.png' ELSE 'doc' || doc_id END AS asset FROM documents),
r AS (SELECT page_id, pr, key, row_number() OVER (PARTITION BY page_id ORDER BY pr) AS rn FROM f JOIN a ON key = asset)
SELECT page_id, pr AS priority, key AS matched FROM r WHERE rn = 1""")
def pair_priority(t):
    d = t.documents
    name = F.concat(F.lit("doc"), col("doc_id").cast("string"))
    assets = d.select(F.when(col("source") == "src0", F.concat(name, F.lit("_mask.png"))).when(col("source") == "src1", F.concat(name, F.lit(".png"))).otherwise(name).alias("asset"))
    n = lambda k: F.concat(F.lit("doc"), (col("page_id") * k).cast("string"))
    keys = [F.concat(n(7), F.lit("_mask.png")), F.concat(n(3), F.lit(".png")), n(1)]
    return jn.pair_by_priority(t.pages.select("page_id"), assets, "page_id", "asset", keys).select("page_id", "priority", "matched")


def _wmed(src: str, v: str) -> str:
    return f"SELECT k, min(v) AS m FROM (SELECT k, {v} AS v, sum(w) OVER (PARTITION BY k ORDER BY {v}) AS cum, sum(w) OVER (PARTITION BY k) AS tot FROM {src}) WHERE cum >= 0.5 * tot GROUP BY 1"


def _solve(src: str, w: str) -> str:
    return (f"SELECT k, (s * sxy - sx * sy) / nullif(s * sxx - sx * sx, 0) AS slope, (sxx * sy - sx * sxy) / nullif(s * sxx - sx * sx, 0) AS off FROM "
            f"(SELECT k, sum({w}) AS s, sum({w}*x) AS sx, sum({w}*y) AS sy, sum({w}*x*x) AS sxx, sum({w}*x*y) AS sxy FROM {src} GROUP BY 1)")


def huber_ctes(src: str, rounds: int) -> str:
    """CTEs that fit ``src(k, x, y, w)``; the result is the table hfit(k, slope, off)."""
    out = [f"hz AS MATERIALIZED (SELECT k, quantile_cont(abs(y), 0.5) AS my FROM {src} GROUP BY 1)", f"h0 AS MATERIALIZED (SELECT {src}.*, my, w AS cur FROM {src} JOIN hz USING (k))"]
    for r in range(rounds):
        out.append(f"f{r} AS MATERIALIZED ({_solve(f'h{r}', 'cur')})")
        if r < rounds - 1:
            out.append(f"e{r} AS MATERIALIZED (SELECT h.*, slope * x + off - y AS r FROM h{r} h JOIN f{r} USING (k))")
            out.append(f"m{r} AS MATERIALIZED ({_wmed(f'e{r}', 'r')})")
            out.append(f"a{r} AS MATERIALIZED (SELECT e.*, abs(r - m) AS ab FROM e{r} e JOIN m{r} USING (k))")
            out.append(f"d{r} AS MATERIALIZED ({_wmed(f'a{r}', 'ab')})")
            out.append(f"h{r + 1} AS MATERIALIZED (SELECT k, x, y, w, my, w * least(1, coalesce(1.345 * greatest(1.4826 * m, 1e-8 * greatest(my, 1)) / nullif(ab, 0), 1)) AS cur FROM a{r} JOIN d{r} USING (k))")
    out.append(f"hfit AS (SELECT * FROM f{rounds - 1})")
    return ",\n".join(out)


_HSRC = "src AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice / 1000 AS y, 1.0::DOUBLE + l_linenumber AS w FROM lineitem)"


def _hfit(t, rounds):
    d = fits.huber_fit(t.lineitem, ["l_suppkey"], col("l_quantity"), col("l_extendedprice") / 1000, 1 + col("l_linenumber"), True, rounds)
    return d.select("l_suppkey", "points", r6("slope").alias("slope"), r6("offset").alias("offset"))


@query("wls_fit", f"WITH {_HSRC}, {huber_ctes('src', 1)} SELECT k AS l_suppkey, (SELECT count(*) FROM src WHERE src.k = hfit.k) AS points, {q6('slope')} AS slope, {q6('off')} AS \"offset\" FROM hfit")
def wls_fit(t):
    return _hfit(t, 1)


@query("huber_fit", f"WITH {_HSRC}, {huber_ctes('src', 12)} SELECT k AS l_suppkey, (SELECT count(*) FROM src WHERE src.k = hfit.k) AS points, {q6('slope')} AS slope, {q6('off')} AS \"offset\" FROM hfit")
def huber_fit(t):
    return _hfit(t, 12)


_TSRC = f"""src AS (SELECT l_suppkey AS k, l_quantity AS x, 50000 / l_extendedprice AS z, 1 / (50000 / l_extendedprice) AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY {LINE_SQL}) - 1 AS i FROM lineitem),
sl AS MATERIALIZED (SELECT a.k, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM src a JOIN src b ON a.k = b.k AND a.i < b.i AND abs(b.x - a.x) > 1e-12 GROUP BY 1),
ts AS MATERIALIZED (SELECT k, slope, quantile_cont(y - slope * x, 0.5) AS off FROM src JOIN sl USING (k) GROUP BY 1, 2)"""


@query("theil_sen", f"WITH {_TSRC} SELECT k AS l_suppkey, {q6('slope')} AS slope, {q6('off')} AS intercept FROM ts")
def theil_sen(t):
    d = fits.theil_sen(t.lineitem, ["l_suppkey"], LINE_ORDER, col("l_quantity"), 1 / (50000 / col("l_extendedprice")))
    return d.select("l_suppkey", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


def tukey_ctes(rounds: int) -> str:
    out = ["tz AS MATERIALIZED (SELECT k, quantile_cont(abs(y), 0.5) AS my FROM src GROUP BY 1)", "t0 AS (SELECT * FROM ts)"]
    for r in range(rounds + 1):
        out.append(f"tr{r} AS MATERIALIZED (SELECT src.*, my, slope * x + off - y AS r, slope, off FROM src JOIN t{r} USING (k) JOIN tz USING (k))")
        out.append(f"tm{r} AS MATERIALIZED (SELECT k, quantile_cont(r, 0.5) AS m FROM tr{r} GROUP BY 1)")
        out.append(f"ta{r} AS MATERIALIZED (SELECT k, quantile_cont(abs(r - m), 0.5) AS mad FROM tr{r} JOIN tm{r} USING (k) GROUP BY 1)")
        out.append(f"tu{r} AS MATERIALIZED (SELECT tr.*, r / (4.685 * greatest(1.4826 * mad, 1e-6 * greatest(my, 1e-9))) AS u FROM tr{r} tr JOIN ta{r} USING (k))")
        if r < rounds:
            out.append(f"tw{r} AS MATERIALIZED (SELECT *, CASE WHEN abs(u) < 1 THEN (1 - u*u) * (1 - u*u) ELSE 0 END AS w FROM tu{r})")
            out.append(f"t{r + 1} AS MATERIALIZED ({_solve(f'tw{r}', 'w')})")
    return ",\n".join(out)


@query("tukey_fit", f"""
WITH {_TSRC}, {tukey_ctes(12)}
SELECT k AS l_suppkey, count(*) AS points, {q6("max(slope)")} AS slope, {q6("max(off)")} AS "offset", count(*) FILTER (WHERE abs(u) < 1) AS inliers,
  {q6("sqrt(avg(CASE WHEN abs(u) < 1 THEN ((1 / greatest(slope * x + off, 1e-6) - z) / z) * ((1 / greatest(slope * x + off, 1e-6) - z) / z) END))")} AS rms_rel FROM tu12 GROUP BY 1""")
def tukey_fit(t):
    d = fits.tukey_fit(t.lineitem, ["l_suppkey"], LINE_ORDER, col("l_quantity"), 50000 / col("l_extendedprice"))
    return d.select("l_suppkey", "points", r6("slope").alias("slope"), r6("offset").alias("offset"), "inliers", r6("rms_rel").alias("rms_rel"))


_ALIGN_RULES = codes_sql(
    ("insufficient_calibration_tracks", "cal < 60"), ("insufficient_heldout_tracks", "held < 30"), ("missing_independent_object_scale", "false"),
    ("degenerate_prediction_range", "flat"), ("alignment_fit_failed", "NOT flat AND slope IS NULL"), ("nonpositive_slope", "coalesce(slope <= 1e-12, false)"),
    ("heldout_median_error_too_high", "coalesce(slope > 1e-12, false) AND coalesce(em > 0.14, false)"), ("heldout_tail_error_too_high", "coalesce(slope > 1e-12, false) AND coalesce(e9 > 1.5, false)"),
    ("too_little_positive_aligned_depth", "coalesce(slope > 1e-12, false) AND coalesce(pf, 0) < 0.5"),
    ("flat_prediction_relief", "coalesce(slope > 1e-12, false) AND coalesce(span / 8 >= 0.04 AND relief < 0.35, false)"))


@query("align_eval", f"""
WITH hs AS (SELECT DISTINCT 'int:' || l_partkey AS token, sha256('{sp.SEED}' || chr(0) || 'int:' || l_partkey) AS digest FROM lineitem),
hr AS (SELECT token, row_number() OVER (ORDER BY digest, token) <= least(greatest(round_even(count(*) OVER () * 0.67, 0), 1), count(*) OVER () - 1) AS iscal FROM hs),
o AS MATERIALIZED (SELECT l_returnflag || ':' || l_suppkey AS k, l_returnflag, l_suppkey, l_quantity / 50 AS p, 20000 / l_extendedprice AS z, 1.0::DOUBLE + l_linenumber AS w, iscal FROM lineitem JOIN hr ON token = 'int:' || l_partkey),
src AS MATERIALIZED (SELECT k, p AS x, 1 / greatest(z, 1e-9) AS y, w FROM o WHERE iscal),
{huber_ctes("src", 12)},
c AS (SELECT k, max(l_returnflag) AS l_returnflag, max(l_suppkey) AS l_suppkey, count(*) FILTER (WHERE iscal) AS cal, count(*) FILTER (WHERE NOT iscal) AS held, quantile_cont(p, 0.75) FILTER (WHERE iscal) - quantile_cont(p, 0.25) FILTER (WHERE iscal) AS iqr,
  CASE WHEN count(*) >= 4 THEN quantile_cont(z, 0.9) - quantile_cont(z, 0.1) ELSE 0 END AS span FROM o GROUP BY 1),
v AS (SELECT c.*, coalesce(iqr, 0) < 1e-5 AS flat, CASE WHEN coalesce(iqr, 0) >= 1e-5 THEN slope END AS slope, off FROM c LEFT JOIN hfit USING (k)),
e AS (SELECT k, quantile_cont(CASE WHEN slope * p + off > 1e-9 THEN abs(1 / (slope * p + off) - z) / 8 END, 0.5) AS em, quantile_cont(CASE WHEN slope * p + off > 1e-9 THEN abs(1 / (slope * p + off) - z) / 8 END, 0.9) AS e9 FROM o JOIN v USING (k) WHERE NOT iscal AND slope > 1e-12 GROUP BY 1),
f AS (SELECT k, avg((slope * p + off > 1e-9)::INT) AS pf, count(*) FILTER (WHERE slope * p + off > 1e-9) AS ins, quantile_cont(CASE WHEN slope * p + off > 1e-9 THEN 1 / (slope * p + off) END, 0.9) - quantile_cont(CASE WHEN slope * p + off > 1e-9 THEN 1 / (slope * p + off) END, 0.1) AS ds FROM o JOIN v USING (k) WHERE slope > 1e-12 GROUP BY 1),
g AS (SELECT v.*, em, e9, pf, CASE WHEN slope > 1e-12 THEN (CASE WHEN ins >= 20 THEN ds ELSE 0 END) / greatest(span, 1e-9) END AS relief FROM v LEFT JOIN e USING (k) LEFT JOIN f USING (k))
SELECT l_returnflag, l_suppkey, cal AS calibration_points, held AS held_out_points, {q6("slope")} AS slope, {q6("em")} AS held_out_median, {q6("e9")} AS held_out_p90, {q6("pf")} AS positive_fraction, {q6("relief")} AS relief_ratio, {_ALIGN_RULES} AS reasons FROM g""")
def align_eval(t):
    li = t.lineitem
    token = F.concat(F.lit("int:"), col("l_partkey").cast("string"))
    roles = sp.hash_split(li, [], token).select("token", "role")
    o = li.withColumn("token", token).join(roles, "token").select("l_returnflag", "l_suppkey", (col("l_quantity") / 50).alias("p"), (20000 / col("l_extendedprice")).alias("z"), (1 + col("l_linenumber")).alias("w"), "role", F.lit(8.0).alias("scale"))
    d = fits.evaluate_alignment(o, ["l_returnflag", "l_suppkey"], prediction="p", z="z", weight="w", role="role", scale="scale", dense=o, limits={"calibration": 60, "held_out": 30, "median": 0.14, "p90": 1.5})
    return d.select("l_returnflag", "l_suppkey", "calibration_points", "held_out_points", *[r6(c).alias(c) for c in ("slope", "held_out_median", "held_out_p90", "positive_fraction", "relief_ratio")], joined("reasons").alias("reasons"))


_ROLL_RULES = codes_sql(
    ("insufficient_aligned_views", "coalesce(av, 0) < 4"), ("too_many_heldout_alignment_failures", "af < 0.8"), ("insufficient_view_pairs", "coalesce(ep, 0) < 3"), ("insufficient_angular_pair_coverage", "coalesce(ab, 0) < 2 OR ma < 40"),
    ("weak_median_reprojection_consistency", "mc < 0.97"), ("weak_tail_reprojection_consistency", "c10 < 0.65"), ("excess_free_space_contradictions", "cr > 0.018"),
    ("insufficient_bidirectional_reprojection_coverage", "mcov < 0.12"), ("too_many_inconsistent_depth_views", "bv > 0.2"))


@query("backend_rollup", f"""
WITH p AS (SELECT l_linestatus AS be, 's' || l_suppkey AS va, 'p' || l_partkey AS vb, 20 + l_tax * 1000 AS angle, l_linenumber // 2 AS bin, l_quantity AS fw, l_linenumber * 10 AS bw, floor(l_extendedprice / 100) AS m, round(l_discount * 200) AS c, l_quantity / 60 AS cov FROM lineitem),
e AS (SELECT *, m / nullif(m + c, 0) AS con FROM p WHERE fw >= 20 AND bw >= 20 AND fw + bw >= 40),
a AS (SELECT l_linestatus AS be, 's' || l_suppkey AS v, avg(round(l_discount * 1e6)) / 1e6 AS err, avg(round(l_discount * 1e6)) < 52500 AS ok FROM lineitem GROUP BY 1, 2),
pv AS (SELECT be, v, quantile_cont(con, 0.5) AS c FROM (SELECT be, va AS v, con FROM e UNION ALL SELECT be, vb, con FROM e) GROUP BY 1, 2),
b AS (SELECT a.be, count(*) AS av, avg((coalesce(c, -1) < 0.72)::INT) AS bv FROM a LEFT JOIN pv USING (be, v) WHERE ok GROUP BY 1),
s AS (SELECT be, avg(ok::INT) AS af, quantile_cont(err, 0.5) AS me FROM a GROUP BY 1),
g AS (SELECT be, count(*) AS ep, count(DISTINCT bin) AS ab, max(angle) AS ma, sum(c) / greatest(sum(m) + sum(c), 1) AS cr, quantile_cont(con, 0.5) AS mc, quantile_cont(con, 0.1) AS c10, quantile_cont(cov, 0.5) AS mcov FROM e GROUP BY 1),
z AS (SELECT * FROM s LEFT JOIN b USING (be) LEFT JOIN g USING (be))
SELECT be AS l_linestatus, av AS aligned_views, ep AS evaluable_pairs, {q6("mc")} AS median_consistency, {q6("cr")} AS contradiction_rate, {q6("bv")} AS bad_view_fraction,
  {q6("least(greatest((1 - least(CASE WHEN me > 0 THEN me ELSE 1 END, 1)) * coalesce(mc, 0) * sqrt(greatest(coalesce(mcov, 0), 0)) * af, 0), 1)")} AS quality_score, {_ROLL_RULES} AS reasons FROM z""")
def backend_rollup(t):
    li = t.lineitem
    pairs = li.select("l_linestatus", F.concat(F.lit("s"), col("l_suppkey").cast("string")).alias("view_a"), F.concat(F.lit("p"), col("l_partkey").cast("string")).alias("view_b"), (20 + col("l_tax") * 1000).alias("angle"),
                      F.expr("l_linenumber div 2").alias("angle_bin"), col("l_quantity").alias("forward"), (col("l_linenumber") * 10).alias("backward"), F.floor(col("l_extendedprice") / 100).alias("matches"),
                      F.round(col("l_discount") * 200).alias("contradictions"), (col("l_quantity") / 60).alias("coverage"))
    # millionths are whole numbers, whose sum does not depend on the order of rows: a mean at the limit is not below it
    a = li.groupBy("l_linestatus", F.concat(F.lit("s"), col("l_suppkey").cast("string")).alias("view")).agg(F.avg(F.round(col("l_discount") * 1e6)).alias("_mean"))
    a = a.select("l_linestatus", "view", (col("_mean") / 1e6).alias("held_out_median"), (col("_mean") < 52500).alias("accepted"))
    d = fits.evaluate_backend(pairs, a, ["l_linestatus"], {"median": 0.97, "free": 0.018})
    return d.select("l_linestatus", "aligned_views", "evaluable_pairs", *[r6(c).alias(c) for c in ("median_consistency", "contradiction_rate", "bad_view_fraction", "quality_score")], joined("reasons").alias("reasons"))
