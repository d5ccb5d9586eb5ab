"""Queries for gates, predicates, projections and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.functions import arrays, geometry as geo, scoring, text
from clipledger.functions.rules import Rule, apply_gates, bounds, one_of
from clipledger.operators import aggregates as agg
from clipledger.operators.quality import capture_warnings, coverage_preflight, excluded_by_reason, frame_flags, score_frames, source_guard
from clipledger.operators.selection import best_evidence
from clipledger.plans.registry import big, codes_sql, joined, parts_sql, q6, query, r6, vector_parts

col = F.col
K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def k_of():
    return F.get_json_object("props", "$.k").cast("int")


@query("gates", f"""
WITH a AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, max(o_totalprice) AS mx, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT o_custkey, {codes_sql(("too_few_orders", "n < 6"), ("low_spend", "s < 1500000"), ("no_large_order", "mx < 400000"), ("no_finished_orders", "f = 0"))} AS reasons,
  {codes_sql(("few_finished", "f < 3", True))} AS warnings, n >= 6 AND s >= 1500000 AND mx >= 400000 AND f > 0 AS accepted FROM a""")
def gates(t):
    a = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.max("o_totalprice").alias("mx"), F.count(F.when(col("o_orderstatus") == "F", 1)).alias("f"))
    d = apply_gates(a, [
        Rule("too_few_orders", col("n") < 6, "more orders are needed", col("n"), 6),
        Rule("low_spend", col("s") < 1500000, "total spend is low", col("s"), 1500000),
        Rule("no_large_order", col("mx") < 400000, "no large order", col("mx"), 400000),
        Rule("no_finished_orders", col("f") == 0, "nothing finished", col("f"), 1),
        Rule("few_finished", col("f") < 3, "few finished", col("f"), 3, warning=True),
    ])
    return d.select("o_custkey", joined("reasons").alias("reasons"), joined("warnings").alias("warnings"), "accepted")


@query("flags", f"""
WITH f AS (SELECT l_suppkey, unnest(list_filter([CASE WHEN l_quantity < 3 THEN 'too_small' END, CASE WHEN l_quantity > 47 THEN 'covers_frame' END,
  CASE WHEN l_tax > 0.07 THEN 'touches_border' END, CASE WHEN l_linenumber > 6 THEN 'fragmented' END], lambda x: x IS NOT NULL)) AS flag, l_extendedprice FROM lineitem)
SELECT l_suppkey, flag, count(*) AS frames, {q6("max(l_extendedprice)")} AS worst FROM f GROUP BY 1, 2""")
def flags(t):
    d = frame_flags(t.lineitem, {"too_small": col("l_quantity") < 3, "covers_frame": col("l_quantity") > 47, "touches_border": col("l_tax") > 0.07, "fragmented": col("l_linenumber") > 6})
    return d.select("l_suppkey", F.explode("flags").alias("flag"), "l_extendedprice").groupBy("l_suppkey", "flag").agg(F.count("*").alias("frames"), r6(F.max("l_extendedprice")).alias("worst"))


@query("excluded_by_reason", """
WITH f AS (SELECT l_suppkey, unnest(list_filter([CASE WHEN l_quantity < 3 THEN 'too_small' END, CASE WHEN l_tax > 0.07 THEN 'touches_border' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem)
SELECT l_suppkey, reason, count(*) AS frames FROM f GROUP BY 1, 2""")
def excluded(t):
    d = frame_flags(t.lineitem, {"too_small": col("l_quantity") < 3, "touches_border": col("l_tax") > 0.07})
    return excluded_by_reason(d, ["l_suppkey"]).select("l_suppkey", "reason", "frames")


@query("preflight", f"""
WITH v AS (SELECT user_id, (epoch_us(ts) % 86400000000) / 240000000.0 AS a, {K_SQL} >= 30 AS sel FROM events),
u AS (SELECT user_id, 'all' AS s, a FROM v UNION ALL SELECT user_id, 'selected', a FROM v WHERE sel),
o AS (SELECT user_id, s, a, lead(a) OVER (PARTITION BY user_id, s ORDER BY a) AS nx FROM (SELECT DISTINCT user_id, s, a FROM u)),
g AS (SELECT user_id, s, CASE WHEN count(*) < 2 THEN 0 ELSE 360 - greatest(max(nx - a), 360 - max(a) + min(a)) END AS span FROM o GROUP BY 1, 2),
p AS (SELECT x.user_id, x.s, max(least(abs(x.a - y.a), 360 - abs(x.a - y.a))) AS w FROM u x JOIN u y USING (user_id, s) GROUP BY 1, 2),
b AS (SELECT user_id, s, count(DISTINCT floor(a / 30)) AS bins FROM u GROUP BY 1, 2),
c AS (SELECT user_id, s, span, w, bins FROM g JOIN p USING (user_id, s) JOIN b USING (user_id, s)),
n AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE sel) AS reg FROM v GROUP BY 1),
j AS (SELECT n.*, x.span AS span_a, x.bins AS bins_a, x.w AS w_a, y.span AS span_s, y.bins AS bins_s, y.w AS w_s FROM n LEFT JOIN (SELECT * FROM c WHERE s = 'all') x USING (user_id) LEFT JOIN (SELECT * FROM c WHERE s = 'selected') y USING (user_id))
SELECT user_id, reg AS registered, {codes_sql(("too_few_registered_views", "reg < 45"), ("registered_fraction_too_low", "reg / total < 0.7"), ("all_span_too_small", "span_a < 330"), ("all_bins_too_few", "bins_a < 12"),
  ("all_opposing_angle_too_small", "w_a < 179.9"), ("selected_span_too_small", "span_s < 330"), ("selected_bins_too_few", "bins_s < 12"), ("selected_opposing_angle_too_small", "w_s < 179.9"))} AS reasons FROM j""")
def preflight(t):
    from clipledger.functions.times import day_micros

    v = t.events.select("user_id", (day_micros(col("ts")) / 240000000.0).alias("a"), (k_of() >= 30).alias("sel"))
    d = coverage_preflight(v, ["user_id"], col("a"), col("sel"), min_views=45, min_fraction=0.7, min_span=330, min_bins=12, min_opposing=179.9)
    return d.select("user_id", "registered", joined("reasons").alias("reasons"))


@query("warnings", f"""
WITH m AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS dur, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS keys,
  quantile_cont(value, 0.5) AS sharp, quantile_cont({K_SQL} / 1000.0, 0.5) AS cl, quantile_cont({K_SQL} / 100.0, 0.75) AS border, quantile_cont(value / 300, 0.75) AS cov FROM events GROUP BY 1)
SELECT user_id, {codes_sql(("short_capture", "dur < 2400000", True), ("low_resolution", "n < 60", True), ("low_frame_rate", "n / dur < 0.000026", True), ("few_keyframes", "keys < 5", True),
  ("low_sharpness", "sharp < 20", True), ("exposure_clipped", "cl > 0.05", True), ("touches_border", "border > 0.75", True), ("little_central_subject", "cov < 0.1", True))} AS warnings FROM m""")
def warnings(t):
    from clipledger.functions.times import micros

    e = t.events.withColumn("us", micros(col("ts")))
    clips = e.groupBy("user_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("duration_s"), F.count("*").alias("n"), F.count(F.when(col("event_type") == "purchase", 1)).alias("keyframes"))
    clips = clips.select("user_id", "duration_s", col("n").alias("display_width"), F.lit(1000).alias("display_height"), (col("n") / col("duration_s")).alias("fps"), "keyframes")
    frames = e.select("user_id", col("value").alias("sharpness"), (k_of() / 1000.0).alias("dark_clipped"), (k_of() / 100.0).alias("border_touch"), (col("value") / 300).alias("central_coverage"))
    limits = {"duration_s": 2400000, "width": 60, "height": 720, "fps": 0.000026, "keyframes": 5, "sharpness": 20, "clipped": 0.05, "border": 0.75, "coverage": 0.1}
    return capture_warnings(clips, frames, ["user_id"], limits).select("user_id", joined("warnings").alias("warnings"))


_ASPECTS = ", ".join(f"abs(r - {a!r}) / {a!r}" for a in (1.0, 4 / 3, 3 / 2, 16 / 9))


@query("source_guard", f"""
WITH v AS (SELECT p_partkey, p_size * 2.0 AS fps, p_type = 'ECONOMY' AS audio, greatest(p_retailprice, 1000) / greatest(1, least(p_retailprice, 1000)) AS r FROM part),
e AS (SELECT *, least({_ASPECTS}) AS err FROM v)
SELECT p_partkey, {q6("err")} AS aspect_error, {codes_sql(("screen_recording", "NOT audio AND fps >= 45 AND err > 0.04"))} AS reasons,
  {codes_sql(("silent_high_frame_rate", "NOT audio AND fps >= 45 AND err <= 0.04", True))} AS warnings FROM e""")
def guard(t):
    v = t.part.select("p_partkey", (col("p_size") * 2.0).alias("fps"), (col("p_type") == "ECONOMY").alias("has_audio"), col("p_retailprice").alias("display_width"), F.lit(1000.0).alias("display_height"))
    d = source_guard(v)
    return d.select("p_partkey", r6("aspect_error").alias("aspect_error"), joined("reasons").alias("reasons"), joined("warnings").alias("warnings"))


_ROT = [0.36, 0.48, -0.8, -0.8, 0.6, 0.0, 0.48, 0.64, 0.6]
_TR = [0.5, -0.25, 4.0]


def _arr(v):
    return F.array(*[F.lit(float(x)) for x in v])


@query("project", f"""
WITH p AS (SELECT l_suppkey, l_quantity / 50 AS x, l_discount * 10 AS y, l_tax * 10 AS z, l_extendedprice FROM lineitem),
c AS (SELECT l_suppkey, {_ROT[0]}*x + {_ROT[1]}*y + ({_ROT[2]})*z + {_TR[0]} AS xc, ({_ROT[3]})*x + {_ROT[4]}*y + {_ROT[5]}*z + ({_TR[1]}) AS yc, {_ROT[6]}*x + {_ROT[7]}*y + {_ROT[8]}*z + {_TR[2]} AS zc FROM p),
n AS (SELECT l_suppkey, zc, xc / CASE WHEN zc > 1e-9 THEN zc ELSE 1 END AS xn, yc / CASE WHEN zc > 1e-9 THEN zc ELSE 1 END AS yn FROM c),
u AS (SELECT l_suppkey, zc, 900 * xn * (1 + 0.05 * (xn*xn + yn*yn)) + 640 AS u, 900 * yn * (1 + 0.05 * (xn*xn + yn*yn)) + 360 AS v FROM n)
SELECT l_suppkey, {q6("avg(u)")} AS u, {q6("avg(v)")} AS v, {q6("min(zc)")} AS z_min, count(*) FILTER (WHERE zc > 1e-9 AND u >= 0 AND u <= 1279 AND v >= 0 AND v <= 719) AS inside FROM u GROUP BY 1""")
def project(t):
    p = geo.project(col("l_quantity") / 50, col("l_discount") * 10, col("l_tax") * 10, _arr(_ROT), _arr(_TR), F.lit(900.0), F.lit(640.0), F.lit(360.0), F.lit(0.05))
    d = t.lineitem.select("l_suppkey", p.alias("p")).select("l_suppkey", "p.*")
    inside = (col("z") > 1e-9) & col("u").between(0, 1279) & col("v").between(0, 719)
    return d.groupBy("l_suppkey").agg(r6(F.avg("u")).alias("u"), r6(F.avg("v")).alias("v"), r6(F.min("z")).alias("z_min"), F.count(F.when(inside, 1)).alias("inside"))


@query("undistort", f"""
WITH RECURSIVE p AS (SELECT DISTINCT l_quantity AS q, l_tax AS x, (l_quantity * 25 - 640) / 900 AS xd, (l_tax * 9000 - 360) / 900 AS yd FROM lineitem),
s AS (SELECT q, x, xd, yd, xd AS xn, yd AS yn, 0 AS i FROM p
  UNION ALL SELECT q, x, xd, yd, xd / (1 + 0.05 * (xn*xn + yn*yn)), yd / (1 + 0.05 * (xn*xn + yn*yn)), i + 1 FROM s WHERE i < 12)
SELECT {q6("q")} AS quantity, {q6("x")} AS tax, {q6("xn")} AS x_norm, {q6("yn")} AS y_norm,
  {q6("0.36*(xn*3-0.5) + (-0.8)*(yn*3+0.25) + 0.48*(3-4.0)")} AS x_world FROM s WHERE i = 12""")
def undistort(t):
    d = t.lineitem.select("l_quantity", "l_tax").distinct()
    cam = (F.lit(900.0), F.lit(640.0), F.lit(360.0), F.lit(0.05))
    u, v = col("l_quantity") * 25, col("l_tax") * 9000
    n = geo.undistort(u, v, *cam)
    w = geo.backproject(u, v, F.lit(3.0), _arr(_ROT), _arr(_TR), *cam)
    return d.select(r6("l_quantity").alias("quantity"), r6("l_tax").alias("tax"), r6(n["x"]).alias("x_norm"), r6(n["y"]).alias("y_norm"), r6(w["x"]).alias("x_world"))


@query("camera_angles", f"""
WITH e AS (SELECT vec_id, part, v1 AS x, v2 AS y, v3 AS z FROM {parts_sql(3)}),
c AS (SELECT vec_id, part, -(0.36*x - 0.8*y + 0.48*z) AS cx, -(0.48*x + 0.6*y + 0.64*z) AS cy, -(-0.8*x + 0.6*z) AS cz FROM e)
SELECT vec_id, part, {q6("degrees(atan2(cy, cx))")} AS azimuth, {q6("degrees(atan2(cz, greatest(sqrt(cx*cx + cy*cy), 1e-9)))")} AS elevation,
  {q6("((0-cx)*0.48 + (0-cy)*0.64 + (0-cz)*0.6) / (sqrt(cx*cx + cy*cy + cz*cz) * sqrt(0.48*0.48 + 0.64*0.64 + 0.6*0.6))")} AS look_at FROM c""")
def camera_angles(t):
    d = vector_parts(t, 3).select("vec_id", "part", geo.centre(_arr(_ROT), col("values")).alias("c"), geo.optical_axis(_arr(_ROT)).alias("a"))
    c = [col("c")[i] for i in range(3)]
    look = geo.look_at_cosine(*c, *[col("a")[i] for i in range(3)], F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return d.select("vec_id", "part", r6(geo.azimuth(c[0], c[1])).alias("azimuth"), r6(geo.elevation(*c)).alias("elevation"), r6(look).alias("look_at"))


def _unit_sql(x, lo, hi, neutral):
    return f"CASE WHEN {hi} - {lo} <= 1e-12 THEN {neutral} ELSE least(greatest(({x} - {lo}) / ({hi} - {lo}), 0), 1) END"


QUALITY_SQL = f"""
v AS (SELECT event_id, user_id, ts, value, {K_SQL} AS k, ln(1 + greatest(value, 0)) AS sharp0, {K_SQL} / 100.0 AS bright, value / 100 AS con0,
  abs({K_SQL} - lag({K_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 255.0 AS mot,
  abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS chg FROM events),
v2 AS (SELECT *, coalesce(mot, 0) AS mot0, coalesce(chg, 0) AS chg0 FROM v),
qq AS (SELECT user_id, quantile_cont(sharp0, 0.1) AS s1, quantile_cont(sharp0, 0.9) AS s9, quantile_cont(con0, 0.1) AS c1, quantile_cont(con0, 0.9) AS c9,
  quantile_cont(mot0, 0.1) AS m1, quantile_cont(mot0, 0.9) AS m9, quantile_cont(chg0, 0.1) AS g1, quantile_cont(chg0, 0.9) AS g9 FROM v2 GROUP BY 1),
quality AS (SELECT event_id, user_id, ts, value, k, least(greatest(0.32 * {_unit_sql("sharp0", "s1", "s9", 0.5)} + 0.18 * greatest(0, 1 - abs(bright - 0.5) / 0.48)
  + 0.12 * {_unit_sql("con0", "c1", "c9", 0.5)} + 0.10 * least(greatest((k / 12.0) / 7.5, 0), 1) + 0.17 * least(1, (k / 400.0) / 0.22) * CASE WHEN bright > 0.70 THEN 0.75 ELSE 1.0 END
  + 0.06 * {_unit_sql("mot0", "m1", "m9", 0.5)} + 0.05 * {_unit_sql("chg0", "g1", "g9", 0.0)} - 0.15 * least(greatest(k / 500.0 + 0.01, 0), 0.5) * 1.4, 0), 1) AS q FROM v2 JOIN qq USING (user_id))"""


def event_quality(t):
    """Frame quality of events: value stands for sharpness and contrast, k for brightness, coverage and clipping."""
    e = t.events.select("event_id", "user_id", "ts", "value", k_of().alias("k"))
    return score_frames(
        e, ["user_id"], ["ts", "event_id"], sharpness=F.greatest(col("value"), F.lit(0.0)), brightness=col("k") / 100.0, contrast=col("value") / 100,
        entropy=col("k") / 12.0, dark=col("k") / 500.0, clipped=F.lit(0.01), central=col("k") / 400.0, border=col("k") / 100.0,
        motion=lambda w: F.coalesce(F.abs(col("k") - F.lag("k").over(w)) / 255.0, F.lit(0.0)),
        change=lambda w: F.coalesce(F.abs(col("value") - F.lag("value").over(w)), F.lit(0.0)), has_coverage=F.lit(True))


@query("quality", f"WITH {QUALITY_SQL} SELECT event_id, {q6('q')} AS quality FROM quality")
def quality(t):
    return event_quality(t).select("event_id", r6("quality").alias("quality"))


@query("cand_score", f"""
WITH s AS (SELECT l_suppkey, 0.44 * least(greatest(ln(1 + l_extendedprice / 100) / ln(1200), 0), 1) + 0.20 * least(greatest(l_discount / 0.16, 0), 1) + 0.13 * least(greatest(l_quantity / 10 / 5, 0), 1)
  + 0.12 * least(greatest(l_tax / 0.10, 0), 1) + 0.04 * 0.9 + 0.02 * 0.8 + 0.05 * sqrt(l_quantity / 50) AS d,
  (l_quantity / 50) * (l_quantity / 50) * (l_quantity / 50) * sqrt(greatest(l_tax * 10, 1e-6)) * ln(1 + greatest(l_extendedprice, 0)) * greatest(0.15, 1 - 2.5 * l_discount * 4) AS f,
  0.35 * 0.9 + 0.25 * 0.8 + 0.20 * least(greatest(l_tax / 0.10, 0), 1) + 0.10 * least(greatest(l_quantity / 50 / 0.55, 0), 1) + 0.10 * (1 - least(greatest(l_discount * 30 / 3, 0), 1))
    - 0.05 * least(greatest(abs(ln((l_quantity / 25) / 1.1)) / 0.28, 0), 1) AS z FROM lineitem)
SELECT l_suppkey, {q6("max(d)")} AS best_detail, {q6("max(f)")} AS best_face, {q6("avg(z)")} AS mean_secondary FROM s GROUP BY 1""")
def cand_score(t):
    q = col("l_quantity")
    detail = scoring.detail_score(col("l_extendedprice") / 100, col("l_discount"), q / 10, col("l_tax"), F.lit(0.9), F.lit(0.8), q / 50)
    face = scoring.face_score(q / 50, col("l_tax") * 10, col("l_extendedprice"), col("l_discount") * 4)
    second = scoring.secondary_score(F.lit(0.9), F.lit(0.8), col("l_tax"), q / 50, col("l_discount") * 30, scoring.aspect_penalty(q / 25, F.lit(1.1)))
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.max(detail)).alias("best_detail"), r6(F.max(face)).alias("best_face"), r6(F.avg(second)).alias("mean_secondary"))


@query("to_depth", f"""
WITH d AS (SELECT l_suppkey, l_quantity * 0.02 - 0.1 AS inv, l_quantity * 0.5 AS sc, least(greatest(1 - l_discount / 0.08, 0), 1) AS conf FROM lineitem)
SELECT l_suppkey, {q6("avg(CASE WHEN inv > 1e-9 THEN 1 / inv END)")} AS inverse_depth, count(*) FILTER (WHERE inv > 1e-9) AS inverse_valid,
  {q6("avg(CASE WHEN sc > 1e-9 THEN sc END)")} AS scaled_depth, {q6("avg(coalesce(conf, 0))")} AS confidence FROM d GROUP BY 1""")
def to_depth(t):
    inv = scoring.to_depth(col("l_quantity"), F.lit(0.02), F.lit(-0.1), "inverse")
    sc = scoring.to_depth(col("l_quantity"), F.lit(0.5), F.lit(-1.0), "scale")
    conf = scoring.held_out_confidence(col("l_discount"), 0.08)
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.avg(inv)).alias("inverse_depth"), F.count(inv).alias("inverse_valid"), r6(F.avg(sc)).alias("scaled_depth"), r6(F.avg(conf)).alias("confidence"))


_WORDS = {"metal": ["ring", "bolt", "nut"], "colour": ["red", "blue"], "widget": []}
_EXACT = {"widget": ["small widget", "large widget"]}


def _has(words):
    return " OR ".join(f"contains(' ' || lab || ' ', ' {w} ')" for w in words)


@query("map_labels", f"""
WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(replace(p_name, ' ', '_-')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS lab FROM part)
SELECT p_partkey, lab AS label, CASE WHEN {_has(["green", "gear"])} THEN NULL WHEN {_has(_WORDS["metal"])} THEN 'metal' WHEN {_has(_WORDS["colour"])} THEN 'colour'
  WHEN lab IN ('small widget', 'large widget') THEN 'widget' END AS kind FROM n""")
def map_labels(t):
    raw = F.replace(col("p_name"), F.lit(" "), F.lit("_-"))
    return t.part.select("p_partkey", text.normalise_label(raw).alias("label"), text.label_kind(raw, ["green", "gear"], _WORDS, _EXACT).alias("kind"))


@query("best_evidence", f"""
WITH r AS (SELECT user_id, event_type, {K_SQL} / 100.0 AS c, event_id FROM events WHERE {K_SQL} / 100.0 >= 0.3)
SELECT user_id, event_type, {q6("max(c)")} AS confidence, max_by(event_id, row(c, event_id)) AS event_id FROM r GROUP BY 1, 2""")
def evidence(t):
    e = t.events.select("user_id", "event_type", (k_of() / 100.0).alias("confidence"), "event_id")
    d = best_evidence(e, ["user_id"], "event_type", "confidence", 0.3, ["event_id"])
    return d.select("user_id", "event_type", r6("confidence").alias("confidence"), "event_id")


@query("id_tokens", """
SELECT c_custkey, 'int:' || c_custkey AS token, 'str:' || c_name AS name_token, regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$') AS safe,
  try_cast(regexp_extract('frame_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '_' || c_custkey * 40 || 'ms', '_(\\d+)ms$', 1) AS BIGINT) AS ms,
  'frame_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded, regexp_replace(regexp_replace('d/' || c_name || '.png', '^.*/', ''), '\\.[^.]*$', '') AS stem,
  substr(regexp_replace(regexp_replace(trim(c_name), '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), 1, 80) AS slug FROM customer""")
def id_tokens(t):
    c = t.customer
    padded = text.padded_name("frame_", col("c_custkey"), 6)
    return c.select(
        "c_custkey", text.id_token(col("c_custkey"), c.schema["c_custkey"].dataType).alias("token"), text.id_token(col("c_name"), c.schema["c_name"].dataType).alias("name_token"),
        text.safe_id(col("c_name")).alias("safe"), text.name_ms(F.concat(padded, F.lit("_"), (col("c_custkey") * 40).cast("string"), F.lit("ms"))).alias("ms"),
        padded.alias("padded"), text.stem(F.concat(F.lit("d/"), col("c_name"), F.lit(".png"))).alias("stem"), text.slug(col("c_name")).alias("slug"))


@query("validate", f"""
SELECT p_partkey, {codes_sql(("size_bounds", "p_size < 5 OR p_size > 45"), ("price_bounds", "p_retailprice < 950 OR p_retailprice > 1900"), ("type_known", "p_type NOT IN ('ECONOMY', 'SMALL', 'STANDARD')"), ("name_safe", "NOT regexp_matches(p_name, '^[a-z]+ [a-z]+$')"))} AS violations FROM part""")
def validate(t):
    rules = [bounds("p_size", 5, 45, "size_bounds"), bounds("p_retailprice", 950, 1900, "price_bounds"), one_of("p_type", ["ECONOMY", "SMALL", "STANDARD"], "type_known"), Rule("name_safe", ~col("p_name").rlike("^[a-z]+ [a-z]+$"))]
    return apply_gates(t.part, rules).select("p_partkey", joined("reasons").alias("violations"))
