"""Queries for grouped, robust and weighted aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.functions.times import day_micros
from clipledger.operators import aggregates as agg
from clipledger.operators.groups import weighted_quantile
from clipledger.operators.selection import best_evidence
from clipledger.plans.registry import big, codes_sql, joined, q6, query, r6

LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_SQL = ", ".join(LINE_ORDER)
col = F.col


def k_of(props="props"):
    return F.get_json_object(props, "$.k").cast("int")


K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("entropy", f"""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, {q6("greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0)")} AS entropy FROM c GROUP BY 1""")
def entropy(t):
    return agg.entropy(t.events, ["user_id"], ["event_type"]).select("user_id", r6("entropy").alias("entropy"))


@query("roi_coverage", f"""
WITH d AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS h,
  l_linenumber BETWEEN 3 AND 5 AND l_quantity BETWEEN 11 AND 40 AS inner_cell,
  (l_linenumber <= 1)::INT + (l_linenumber >= 7)::INT + (l_quantity <= 1)::INT + (l_quantity >= 50)::INT AS b FROM lineitem)
SELECT l_suppkey, {q6("avg(h)")} AS coverage, {q6("coalesce(avg(CASE WHEN inner_cell THEN h END), avg(h))")} AS central_coverage,
  {q6("coalesce(sum(h * b) / nullif(sum(b), 0), 0)")} AS border_touch FROM d GROUP BY 1""")
def roi_coverage(t):
    central = col("l_linenumber").between(3, 5) & col("l_quantity").between(11, 40)
    edges = [col("l_linenumber") <= 1, col("l_linenumber") >= 7, col("l_quantity") <= 1, col("l_quantity") >= 50]
    border = sum((e.cast("int") for e in edges), F.lit(0))
    d = agg.region_coverage(t.lineitem, ["l_suppkey"], col("l_returnflag") == "R", central, border)
    return d.select("l_suppkey", *[r6(c).alias(c) for c in ("coverage", "central_coverage", "border_touch")])


@query("temporal_change", f"""
WITH v AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(hour(ts) AS BIGINT) AS hour, sum(value) AS v FROM events GROUP BY 1, 2, 3),
g AS (SELECT event_type, hour, quantile_cont(v, 0.5) AS background FROM v GROUP BY 1, 2),
d AS (SELECT v.*, background, abs(v - background) AS distance FROM v JOIN g USING (event_type, hour)),
m AS (SELECT event_type, day, quantile_cont(distance, 0.5) AS med FROM d GROUP BY 1, 2),
a AS (SELECT d.event_type, d.day, med, quantile_cont(abs(distance - med), 0.5) AS mad FROM d JOIN m USING (event_type, day) GROUP BY 1, 2, 3)
SELECT event_type, CAST(day AS VARCHAR) AS day, hour, {q6("background")} AS background, {q6("greatest(10, med + 2.25 * greatest(mad, 1))")} AS threshold,
  distance >= greatest(10, med + 2.25 * greatest(mad, 1)) AS changed FROM d JOIN a USING (event_type, day)""")
def temporal_change(t):
    v = t.events.groupBy("event_type", F.to_date("ts").alias("day"), big(F.hour("ts")).alias("hour")).agg(F.sum("value").alias("v"))
    d = agg.temporal_change(v, ["event_type"], "day", ["hour"], "v")
    return d.select("event_type", col("day").cast("string").alias("day"), "hour", r6("background").alias("background"), r6("threshold").alias("threshold"), "changed")


@query("robust_unit", f"""
WITH v AS (SELECT o_orderkey, o_orderpriority, ln(1 + o_totalprice) AS x FROM orders),
q AS (SELECT o_orderpriority, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM v GROUP BY 1)
SELECT o_orderkey, {q6("CASE WHEN hi - lo <= 1e-12 THEN 0.5 ELSE least(greatest((x - lo) / (hi - lo), 0), 1) END")} AS price_unit FROM v JOIN q USING (o_orderpriority)""")
def robust_unit(t):
    d = agg.robust_unit(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], price_unit=F.log1p("o_totalprice"))
    return d.select("o_orderkey", r6("price_unit").alias("price_unit"))


@query("weighted_median", f"""
WITH v AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
c AS (SELECT l_suppkey, v, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_suppkey) AS tot FROM v)
SELECT l_suppkey, {q6("min(v)")} AS median_price FROM c WHERE cum >= 0.5 * tot GROUP BY 1""")
def weighted_median(t):
    d = weighted_quantile(t.lineitem, ["l_suppkey"], col("l_extendedprice"), col("l_quantity"), 0.5, "m")
    return d.select("l_suppkey", r6("m").alias("median_price"))


@query("iou", f"""
WITH m AS (SELECT l_suppkey, l_partkey, max((l_returnflag = 'R')::INT) AS a, max((l_returnflag = 'A')::INT) AS b FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(sum(a * b) AS BIGINT) AS intersection, CAST(sum(greatest(a, b)) AS BIGINT) AS "union",
  {q6("coalesce(sum(a * b) / nullif(sum(greatest(a, b)), 0), 0)")} AS iou, {q6("sum(a * b) / nullif(sum(a), 0)")} AS "precision",
  {q6("sum(a * b) / nullif(sum(b), 0)")} AS recall FROM m GROUP BY 1""")
def iou(t):
    d = agg.set_overlap(t.lineitem, ["l_suppkey"], ["l_partkey"], col("l_returnflag") == "R", col("l_returnflag") == "A")
    return d.select("l_suppkey", big("intersection").alias("intersection"), big("union").alias("union"), *[r6(c).alias(c) for c in ("iou", "precision", "recall")])


@query("support_fraction", f"""
WITH f AS (SELECT l_returnflag, l_partkey, sum(l_extendedprice) AS area, count(DISTINCT l_suppkey) - 1 AS support FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, {q6("sum(CASE WHEN support >= 1 THEN area ELSE 0 END) / sum(area)")} AS observed,
  {q6("sum(CASE WHEN support >= 2 THEN area ELSE 0 END) / sum(area)")} AS multi_view FROM f GROUP BY 1""")
def support_fraction(t):
    f = t.lineitem.groupBy("l_returnflag", "l_partkey").agg(F.sum("l_extendedprice").alias("area"), (F.count_distinct("l_suppkey") - 1).alias("support"))
    d = agg.support_fraction(f, ["l_returnflag"], col("area"), col("support"))
    return d.select("l_returnflag", r6("observed").alias("observed"), r6("multi_view").alias("multi_view"))


@query("dispersion", f"""
WITH s AS (SELECT l_returnflag, l_partkey, round(sqrt(greatest((var_pop(l_discount) + var_pop(l_tax)) / 2, 0)), 9) AS rms, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
v AS (SELECT l_returnflag, rms, sum(w) AS w FROM s WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT l_returnflag, rms, sum(w) OVER (PARTITION BY l_returnflag ORDER BY rms) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS tot FROM v)
SELECT l_returnflag, {q6("min(rms)")} AS dispersion FROM c WHERE cum >= 0.5 * tot GROUP BY 1""")
def dispersion(t):
    d = agg.dispersion(t.lineitem, ["l_returnflag"], ["l_partkey"], ["l_discount", "l_tax"], "l_quantity")
    return d.select("l_returnflag", r6("dispersion").alias("dispersion"))


@query("mad", f"""
WITH m AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY 1),
a AS (SELECT o_orderstatus, med, quantile_cont(abs(o_totalprice - med), 0.5) AS mad FROM orders JOIN m USING (o_orderstatus) GROUP BY 1, 2)
SELECT o_orderstatus, {q6("med")} AS median, {q6("mad")} AS mad, {q6("greatest(1.4826 * mad, 1e-9)")} AS scale FROM a""")
def mad(t):
    d = agg.robust_scale(t.orders, ["o_orderstatus"], col("o_totalprice"))
    return d.select("o_orderstatus", *[r6(c).alias(c) for c in ("median", "mad", "scale")])


@query("circular_coverage", f"""
WITH v AS (SELECT user_id, (epoch_us(ts) % 86400000000) / 240000000.0 AS a, value AS e FROM events),
o AS (SELECT user_id, a, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS nx FROM (SELECT DISTINCT user_id, a FROM v)),
g AS (SELECT user_id, greatest(max(nx - a), 360 - max(a) + min(a)) AS gap FROM o GROUP BY 1),
p AS (SELECT x.user_id, max(least(abs(x.a - y.a), 360 - abs(x.a - y.a))) AS widest FROM v x JOIN v y USING (user_id) GROUP BY 1),
b AS (SELECT user_id, count(*) AS n, count(DISTINCT floor(a / 30)) AS bins, max(e) - min(e) AS es FROM v GROUP BY 1)
SELECT user_id, bins, {q6("es")} AS elevation_span, {q6("widest")} AS max_pair_angle, {q6("CASE WHEN n < 2 THEN 0 ELSE 360 - gap END")} AS span
FROM b JOIN g USING (user_id) JOIN p USING (user_id)""")
def circular_coverage(t):
    angle = day_micros(col("ts")) / 240000000.0
    d = agg.circular_coverage(t.events, ["user_id"], angle, col("value"))
    return d.select("user_id", "bins", r6("elevation_span").alias("elevation_span"), r6("max_pair_angle").alias("max_pair_angle"), r6("span").alias("span"))


@query("pca3", f"""
WITH m AS (SELECT l_suppkey, var_pop(l_quantity) AS a, var_pop(l_discount * 300) AS b, var_pop(l_tax * 300) AS c,
  covar_pop(l_quantity, l_discount * 300) AS d, covar_pop(l_quantity, l_tax * 300) AS e, covar_pop(l_discount * 300, l_tax * 300) AS f FROM lineitem GROUP BY 1),
n AS (SELECT *, (a + b + c) / 3 AS q FROM m),
p AS (SELECT *, sqrt(((a-q)*(a-q) + (b-q)*(b-q) + (c-q)*(c-q) + 2*(d*d + e*e + f*f)) / 6) AS p FROM n),
r AS (SELECT *, acos(least(greatest((((a-q)/p) * (((b-q)/p) * ((c-q)/p) - (f/p)*(f/p)) - (d/p) * ((d/p) * ((c-q)/p) - (f/p)*(e/p)) + (e/p) * ((d/p)*(f/p) - ((b-q)/p)*(e/p))) / 2, -1), 1)) / 3 AS phi FROM p),
z AS (SELECT l_suppkey, q + 2*p*cos(phi) AS e1, q + 2*p*cos(phi + 2*pi()/3) AS e3, q FROM r)
SELECT l_suppkey, {q6("e1")} AS eigen_1, {q6("3*q - e1 - e3")} AS eigen_2, {q6("e3")} AS eigen_3, {q6("greatest(3*q - e1 - e3, 0) / e1")} AS second_ratio FROM z""")
def pca3(t):
    d = agg.pca3(t.lineitem, ["l_suppkey"], col("l_quantity"), col("l_discount") * 300, col("l_tax") * 300)
    return d.select("l_suppkey", *[r6(c).alias(c) for c in ("eigen_1", "eigen_2", "eigen_3", "second_ratio")])


@query("pose_metrics", f"""
WITH p AS (SELECT o_orderpriority, count(*) AS views, count(*) FILTER (WHERE o_orderstatus <> 'P') AS ind, stddev_pop(o_totalprice) / greatest(avg(o_totalprice), 1e-12) AS cv,
  quantile_cont(o_totalprice, 0.5) AS rm, quantile_cont(cos(o_totalprice / 200000), 0.5) AS lm, max(o_custkey) AS tot FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority, string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) AS source_counts
  FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderpriority, views, ind AS independent_views, {q6("cv")} AS radius_cv, {q6("rm")} AS radius_median, {q6("lm")} AS look_median,
  {q6("ind / nullif(tot, 0)")} AS registered_fraction, source_counts FROM p JOIN c USING (o_orderpriority)""")
def pose_metrics(t):
    d = agg.pose_metrics(t.orders, ["o_orderpriority"], col("o_totalprice"), F.cos(col("o_totalprice") / 200000), col("o_orderstatus"), ["P"], col("o_custkey"))
    counts = F.array_join(F.transform(F.map_entries("source_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return d.select("o_orderpriority", "views", "independent_views", *[r6(c).alias(c) for c in ("radius_cv", "radius_median", "look_median", "registered_fraction")], counts.alias("source_counts"))


@query("robust_extent", f"""
WITH b AS (SELECT l_suppkey, count(*) AS points, quantile_cont(l_quantity, 0.05) AS x0, quantile_cont(l_quantity, 0.95) AS x1,
  quantile_cont(l_discount, 0.05) AS y0, quantile_cont(l_discount, 0.95) AS y1, quantile_cont(l_tax, 0.05) AS z0, quantile_cont(l_tax, 0.95) AS z1 FROM lineitem GROUP BY 1),
d AS (SELECT *, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)) AS diag FROM b)
SELECT l_suppkey, points, {q6("x0")} AS x_low, {q6("x1")} AS x_high, {q6("CASE WHEN points >= 12 AND diag > 1e-9 THEN diag END")} AS scale,
  CASE WHEN points < 12 THEN 'insufficient_points' WHEN diag <= 1e-9 THEN 'degenerate_scale' END AS reason FROM d""")
def robust_extent(t):
    d = agg.robust_extent(t.lineitem, ["l_suppkey"], {"x": col("l_quantity"), "y": col("l_discount"), "z": col("l_tax")})
    return d.select("l_suppkey", "points", r6("x_low").alias("x_low"), r6("x_high").alias("x_high"), r6("scale").alias("scale"), "reason")


@query("outlier_shell", f"""
WITH k AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem WHERE l_linenumber >= 3),
c AS (SELECT l_suppkey, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM k GROUP BY 1),
r AS (SELECT l_suppkey, sqrt((x-mx)*(x-mx) + (y-my)*(y-my)) AS r FROM k JOIN c USING (l_suppkey)),
p AS (SELECT l_suppkey, quantile_cont(r, 0.75) AS p75 FROM r GROUP BY 1)
SELECT l_suppkey, count(*) AS kept, {q6("max(r)")} AS max_radius, {q6("avg(r)")} AS mean_radius FROM r JOIN p USING (l_suppkey) WHERE r <= 1.6 * greatest(p75, 1e-9) GROUP BY 1""")
def outlier_shell(t):
    d = agg.drop_outlier_shell(t.lineitem, ["l_suppkey"], {"x": col("l_quantity"), "y": col("l_extendedprice") / 1000}, col("l_linenumber"), factor=1.6)
    return d.groupBy("l_suppkey").agg(F.count("*").alias("kept"), r6(F.max("radius")).alias("max_radius"), r6(F.avg("radius")).alias("mean_radius"))


@query("error_summary", f"""
WITH e AS (SELECT l_suppkey, CASE WHEN l_tax > 1e-9 THEN abs(l_extendedprice - l_quantity * 1800) END AS ab FROM lineitem)
SELECT l_suppkey, count(ab) AS count, {q6("quantile_cont(ab / 50000, 0.5)")} AS median, {q6("quantile_cont(ab / 50000, 0.9)")} AS p90,
  {q6("sqrt(avg((ab / 50000) * (ab / 50000)))")} AS rms, {q6("quantile_cont(ab, 0.5)")} AS absolute_median FROM e GROUP BY 1""")
def error_summary(t):
    target = F.when(col("l_tax") > 1e-9, col("l_quantity") * 1800).otherwise(0.0)
    d = agg.error_summary(t.lineitem, ["l_suppkey"], col("l_extendedprice"), target, F.lit(50000.0))
    return d.select("l_suppkey", "count", *[r6(c).alias(c) for c in ("median", "p90", "rms", "absolute_median")])


@query("hints", f"""
WITH f AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS nf FROM events GROUP BY 1),
e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, max({K_SQL} / 100.0) AS c FROM events WHERE {K_SQL} / 100.0 >= 0.2 GROUP BY 1, 2, 3),
s AS (SELECT user_id, event_type, count(*) AS sf, count(*) / max(nf) AS frac, round(avg(c) * sqrt(count(*) / max(nf)), 12) AS score FROM e JOIN f USING (user_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rn FROM s),
w AS (SELECT user_id, max(event_type) FILTER (WHERE rn = 1) AS hint, max(score) FILTER (WHERE rn = 1) AS score, max(sf) FILTER (WHERE rn = 1) AS sf,
  max(frac) FILTER (WHERE rn = 1) AS frac, max(event_type) FILTER (WHERE rn = 2) AS runner_up, round(max(score) FILTER (WHERE rn = 1) - coalesce(max(score) FILTER (WHERE rn = 2), 0), 12) AS margin FROM r WHERE rn <= 2 GROUP BY 1)
SELECT user_id, hint, {q6("score")} AS score, sf AS support_frames, runner_up, {q6("margin")} AS margin,
  {codes_sql(("no_mapped_evidence", "hint IS NULL"), ("score_too_low", "score < 0.3"), ("too_few_support_frames", "sf < 2"), ("support_fraction_too_low", "frac < 0.15"), ("margin_too_small", "margin < 0.08"))} AS reasons FROM f LEFT JOIN w USING (user_id)""")
def hints(t):
    e = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type", (k_of() / 100.0).alias("c"))
    frames = e.groupBy("user_id").agg(F.count_distinct("day").alias("n_frames"))
    best = best_evidence(e, ["user_id", "day"], "event_type", "c", 0.20, [])
    d = agg.aggregate_hints(best, ["user_id"], "day", "event_type", "c", frames)
    return d.select("user_id", "hint", r6("score").alias("score"), "support_frames", "runner_up", r6("margin").alias("margin"), joined("reasons").alias("reasons"))


@query("persistence", f"""
WITH v AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 15) AS g, count(*) FILTER (WHERE {K_SQL} >= 50) AS p, count(*) FILTER (WHERE value > 10) AS a FROM events GROUP BY 1),
r AS (SELECT *, CASE WHEN g >= greatest(3, ceil(0.45 * n)) THEN 'green' WHEN p >= greatest(4, ceil(0.5 * n)) THEN 'pink' ELSE 'generic' END AS route FROM v)
SELECT user_id, n, g AS green, p AS pink, route, (route <> 'generic' AND a >= 6) OR a / n >= 0.55 AS use_anchor FROM r""")
def persistence(t):
    d = agg.persistence_vote(t.events, ["user_id"], col("value") > 15, k_of() >= 50, col("value") > 10)
    return d.select("user_id", "n", "green", "pink", "route", "use_anchor")


@query("hist_distance", f"""
WITH h AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT day, lead(day) OVER (ORDER BY day) AS nx, sum(n) AS s FROM h GROUP BY 1),
u AS (SELECT t.day, t.nx, t.s, t2.s AS s2 FROM t JOIN t t2 ON t2.day = t.nx),
b AS (SELECT u.day, sum(sqrt(a.n * c.n)) AS bc FROM u JOIN h a ON a.day = u.day JOIN h c ON c.day = u.nx AND c.event_type = a.event_type GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, CAST(nx AS VARCHAR) AS next_day, {q6("sqrt(greatest(0, round(1 - coalesce(bc, 0) / sqrt(s * s2), 9)))")} AS distance FROM u LEFT JOIN b USING (day)""")
def hist_distance(t):
    d = agg.hist_distance(t.events.select(F.to_date("ts").alias("day"), "event_type"), [], "day", "event_type")
    squared = F.round(col("distance") * col("distance"), 9)
    return d.select(col("day").cast("string").alias("day"), col("next_frame").cast("string").alias("next_day"), r6(F.sqrt(squared)).alias("distance"))


_CF = [("discount", "l_discount"), ("tax", "l_tax"), ("aspect", "l_quantity / 50")]


@query("clip_features", f"""
WITH f AS (SELECT *, l_quantity / 50 AS aspect, l_extendedprice / 100000 AS quality FROM lineitem),
v AS (SELECT * FROM f WHERE quality >= 0.20),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, CAST(round_even(aspect / 0.05, 0) AS BIGINT) ORDER BY quality DESC, {LINE_SQL}) AS rn FROM v),
p AS (SELECT * FROM r WHERE rn = 1),
q AS (SELECT l_suppkey, {", ".join(f"{q6(f'quantile_cont({e}, {x})')} AS {n}_q{round(x * 100):02d}" for n, e in (("discount", "l_discount"), ("tax", "l_tax"), ("aspect", "aspect")) for x in (0.1, 0.5, 0.9))},
  quantile_cont(aspect, 0.1) AS a10, quantile_cont(aspect, 0.9) AS a90 FROM p GROUP BY 1),
d AS (SELECT p.l_suppkey, aspect, l_tax <= 0.04 AS rd, a10, a90, aspect >= greatest(0.12, 0.85 * a90) AS face, aspect <= least(0.60, greatest(0.04, 1.3 * a10)) AS edge FROM p JOIN q USING (l_suppkey)),
g AS (SELECT l_suppkey, count(*) AS view_clusters, count(*) FILTER (WHERE face) AS face_views, count(*) FILTER (WHERE edge) AS edge_views,
  {q6("avg(face::INT)")} AS face_fraction, {q6("avg(edge::INT)")} AS edge_fraction, {q6("avg((face AND rd)::INT)")} AS rounded_face_fraction,
  {q6("min(aspect) / greatest(max(aspect), 1e-6)")} AS edge_face_ratio, {q6("(max(a90) - max(a10)) / greatest(max(a90), 1e-6)")} AS aspect_view_range FROM d GROUP BY 1),
m AS (SELECT l_suppkey, {q6("quantile_cont(quality, 0.5)")} AS median_quality FROM v GROUP BY 1)
SELECT q.* EXCLUDE (a10, a90), g.* EXCLUDE (l_suppkey), median_quality FROM q JOIN g USING (l_suppkey) JOIN m USING (l_suppkey)""")
def clip_features(t):
    f = t.lineitem.select(*LINE_ORDER, col("l_discount").alias("discount"), col("l_tax").alias("tax"), (col("l_quantity") / 50).alias("aspect"), (col("l_extendedprice") / 100000).alias("quality"))
    d = agg.clip_features(f, ["l_suppkey"], ["discount", "tax", "aspect"], "aspect", col("tax") <= 0.04, "quality", LINE_ORDER)
    return d.select(*[c if c == "l_suppkey" or kind == "bigint" else r6(c).alias(c) for c, kind in d.dtypes])


@query("clip_evidence", """
SELECT l_suppkey, count(*) AS input_masks, count(*) FILTER (WHERE l_extendedprice / 100000 >= 0.2) AS valid_masks, round(avg((l_tax / 4 > 0.01)::INT), 4) AS clipped_fraction,
  round(max(l_discount), 4) AS maximum_hole_fraction, round(min(l_quantity / 50), 4) AS minimum_dominance FROM lineitem GROUP BY 1""")
def clip_evidence(t):
    d = t.lineitem.withColumn("q", col("l_extendedprice") / 100000)
    return agg.clip_evidence(d, ["l_suppkey"], "q", col("l_tax") / 4, col("l_discount"), col("l_quantity") / 50)


@query("dense_band", f"""
WITH v AS (SELECT l_suppkey, l_quantity / 50 AS r, l_tax * greatest(0, 1 - l_discount) AS w FROM lineitem),
n AS (SELECT l_suppkey, count(*) AS n, quantile_cont(r, 0.7) AS p70 FROM v GROUP BY 1),
x AS (SELECT DISTINCT l_suppkey, r AS start, count(*) OVER z AS c, sum(w) OVER z AS sw, quantile_cont(r, 0.5) OVER z AS med FROM v
  WINDOW z AS (PARTITION BY l_suppkey ORDER BY r RANGE BETWEEN CURRENT ROW AND 0.10 FOLLOWING)),
b AS (SELECT l_suppkey, med, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(sw, 9) DESC, start DESC) AS rn FROM x JOIN n USING (l_suppkey) WHERE c >= greatest(4, ceil(0.3 * n))),
c AS (SELECT n.l_suppkey, n, med IS NOT NULL AS supported, greatest(0.30, coalesce(med, p70)) AS centre FROM n LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (l_suppkey))
SELECT l_suppkey, CAST(n AS BIGINT) AS n, supported, {q6("centre")} AS centre, {q6("greatest(0.30, centre - greatest(0.06, centre * 0.15))")} AS lower,
  {q6("greatest(centre, least(1.0, centre + greatest(0.06, centre * 0.15)))")} AS upper FROM c""")
def dense_band(t):
    f = t.lineitem.select("l_suppkey", (col("l_quantity") / 50).alias("r0"), "l_tax", "l_discount")
    d = agg.dense_band(f, ["l_suppkey"], "r0", col("l_tax") * F.greatest(F.lit(0.0), 1 - col("l_discount")))
    return d.select("l_suppkey", big("n").alias("n"), "supported", *[r6(c).alias(c) for c in ("centre", "lower", "upper")])


@query("infer_ratio", f"""
WITH v AS (SELECT l_suppkey, l_quantity / 50 AS r, l_quantity / 50 <= 0.60 * 0.8 AS p FROM lineitem),
m AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE p) AS profiles, quantile_cont(CASE WHEN p THEN r END, 0.5) AS med FROM v GROUP BY 1)
SELECT l_suppkey, n, profiles, profiles >= greatest(3, ceil(0.15 * n)) AS observed,
  {q6("CASE WHEN profiles >= greatest(3, ceil(0.15 * n)) THEN least(greatest(med / greatest(0.9, 0.30) * 0.68, 0.08), 0.30) ELSE 0.16 END")} AS depth_ratio FROM m""")
def infer_ratio(t):
    f = t.lineitem.select("l_suppkey", (col("l_quantity") / 50).alias("r"), F.lit(0.8).alias("centre"), F.lit(0.9).alias("aspect"))
    d = agg.infer_ratio(f, ["l_suppkey"], "r", "centre", "aspect")
    return d.select("l_suppkey", "n", "profiles", "observed", r6("depth_ratio").alias("depth_ratio"))


@query("median_blend", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, {LINE_SQL}) AS rn FROM lineitem)
SELECT l_partkey, count(*) AS samples, {q6("quantile_cont(l_quantity, 0.5)")} AS quantity, {q6("quantile_cont(l_extendedprice, 0.5)")} AS price FROM r WHERE rn <= 5 GROUP BY 1""")
def median_blend(t):
    d = agg.median_blend(t.lineitem, ["l_partkey"], col("l_discount"), LINE_ORDER, 5, ["l_quantity", "l_extendedprice"])
    return d.select("l_partkey", "samples", r6("l_quantity").alias("quantity"), r6("l_extendedprice").alias("price"))


@query("reject_outliers", f"""
WITH j AS (SELECT l_suppkey, l_quantity AS a, p_size AS fa, l_extendedprice / 1000 AS b, p_retailprice / 50 AS fb FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT *, sqrt((a-fa)*(a-fa) + (b-fb)*(b-fb)) > 40 AS rej FROM j)
SELECT l_suppkey, count(*) FILTER (WHERE rej) AS rejected, count(*) FILTER (WHERE NOT rej) AS kept, {q6("avg(CASE WHEN rej THEN fa ELSE a END)")} AS mean_a, {q6("avg(CASE WHEN rej THEN fb ELSE b END)")} AS mean_b FROM d GROUP BY 1""")
def reject_outliers(t):
    j = t.lineitem.join(t.part, col("l_partkey") == col("p_partkey")).select(
        "l_suppkey", col("l_quantity").alias("a"), col("p_size").cast("double").alias("fa"), (col("l_extendedprice") / 1000).alias("b"), (col("p_retailprice") / 50).alias("fb"))
    d = agg.reject_outliers(j, [("a", "fa"), ("b", "fb")], F.lit(40.0))
    return d.groupBy("l_suppkey").agg(F.count(F.when(col("rejected"), 1)).alias("rejected"), F.count(F.when(~col("rejected"), 1)).alias("kept"), r6(F.avg("a")).alias("mean_a"), r6(F.avg("b")).alias("mean_b"))


@query("gain", f"""
WITH b AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY 1), f AS (SELECT quantile_cont(m, 0.5) AS t FROM b WHERE m > 0)
SELECT l_suppkey, {q6("m")} AS brightness, {q6("least(greatest(coalesce((SELECT t FROM f), 128) / greatest(m, 1), 0.6), 1.8)")} AS gain FROM b""")
def gain(t):
    d = agg.gain_normalise(t.lineitem, ["l_suppkey"], col("l_extendedprice"))
    return d.select("l_suppkey", r6("brightness").alias("brightness"), r6("gain").alias("gain"))


@query("patch_stats", f"""
WITH r AS (SELECT l_suppkey AS patch, date_diff('day', DATE '1990-01-01', CAST(min(l_shipdate) AS DATE)) AS lo FROM lineitem GROUP BY 1)
SELECT patch, count(*) AS pixels, {q6("quantile_cont(l_extendedprice, 0.5)")} AS median, {q6("quantile_cont(l_extendedprice, 0.62)")} AS upper
FROM lineitem JOIN r ON l_suppkey = patch AND date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) >= lo AND date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) < lo + 365 GROUP BY 1""")
def patch_stats(t):
    px = t.lineitem.select("l_suppkey", F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).alias("day"), "l_extendedprice")
    rects = px.groupBy("l_suppkey").agg(F.min("day").alias("lo")).select("l_suppkey", col("l_suppkey").alias("patch"), "lo", (col("lo") + 365).alias("hi"))
    d = agg.patch_stats(px, rects, ["l_suppkey"], "day", 120, "l_extendedprice", "patch")
    return d.select("patch", "pixels", r6("median").alias("median"), r6("upper").alias("upper"))


@query("agreement", f"""
WITH v AS (SELECT l_suppkey, 1 - l_discount * 5 AS i, l_linenumber = 1 AS h FROM lineitem)
SELECT l_suppkey, {q6("quantile_cont(i, 0.5)")} AS median_iou, {q6("quantile_cont(i, 0.1)")} AS p10_iou, {q6("min(i)")} AS min_iou, {q6("avg((i >= 0.58)::INT)")} AS good_fraction,
  count(*) FILTER (WHERE h) AS held_out_views, {q6("quantile_cont(CASE WHEN h THEN i END, 0.5)")} AS held_out_median FROM v GROUP BY 1""")
def agreement(t):
    d = agg.agreement(t.lineitem, ["l_suppkey"], 1 - col("l_discount") * 5, col("l_linenumber") == 1)
    return d.select("l_suppkey", "held_out_views", *[r6(c).alias(c) for c in ("median_iou", "p10_iou", "min_iou", "good_fraction", "held_out_median")])


_PIXELS = "px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v::DOUBLE AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings))"


def embedding_pixels(t):
    """Embeddings as images of 8 by 8."""
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.expr("i div 8").alias("y"), (col("i") % 8).alias("x"), col("v").cast("double").alias("v"))


@query("mask_coverage", f"""
WITH {_PIXELS}, m AS (SELECT *, (v > 0)::INT::DOUBLE AS h, x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AS central, (y = 0)::INT + (y = 7)::INT + (x = 0)::INT + (x = 7)::INT AS b FROM px)
SELECT vec_id, {q6("avg(h)")} AS coverage, {q6("avg(h) FILTER (WHERE central)")} AS central_coverage, {q6("sum(h * b) / sum(b)")} AS border_touch FROM m GROUP BY 1""")
def mask_coverage(t):
    d = agg.mask_coverage(embedding_pixels(t).withColumn("hit", (col("v") > 0).cast("int")), ["vec_id"], F.lit(8), F.lit(8))
    return d.select("vec_id", *[r6(c).alias(c) for c in ("coverage", "central_coverage", "border_touch")])


@query("frame_metrics", f"""
WITH {_PIXELS}, c AS (SELECT vec_id, y, x, least(greatest(floor((v + 0.5) * 300), 0), 255) AS b, least(greatest(floor((v + 0.4) * 300), 0), 255) AS g, least(greatest(floor((0.5 - v) * 300), 0), 255) AS r FROM px),
k AS (SELECT *, round_even(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r, 0) AS k FROM c),
n AS (SELECT *, coalesce(lag(k) OVER h, lead(k) OVER h) + coalesce(lead(k) OVER h, lag(k) OVER h) + coalesce(lag(k) OVER w, lead(k) OVER w) + coalesce(lead(k) OVER w, lag(k) OVER w) - 4 * k AS lap
  FROM k WINDOW h AS (PARTITION BY vec_id, y ORDER BY x), w AS (PARTITION BY vec_id, x ORDER BY y)),
e AS (SELECT vec_id, log2(64) - sum(c * log2(c)) / 64 AS en FROM (SELECT vec_id, k, count(*) AS c FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT n.vec_id, {q6("avg(k) / 255")} AS brightness_mean, {q6("stddev_pop(k) / 255")} AS contrast_stddev, {q6("var_pop(lap)")} AS sharpness_laplacian, {q6("any_value(greatest(en, 0))")} AS entropy_bits FROM n JOIN e USING (vec_id) GROUP BY 1""")
def frame_metrics(t):
    part = lambda c: F.least(F.greatest(F.floor(c * 300), F.lit(0)), F.lit(255)).cast("double")
    px = embedding_pixels(t).select("vec_id", "y", "x", part(col("v") + 0.5).alias("b"), part(col("v") + 0.4).alias("g"), part(0.5 - col("v")).alias("r"))
    d = agg.frame_metrics(px, ["vec_id"])
    return d.select("vec_id", *[r6(c).alias(c) for c in ("brightness_mean", "contrast_stddev", "sharpness_laplacian", "entropy_bits")])
