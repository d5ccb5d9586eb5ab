"""Queries for ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.functions.times import micros
from clipledger.operators import windows as win
from clipledger.operators.aggregates import best_per_bin
from clipledger.plans.aggregates import LINE_ORDER, LINE_SQL
from clipledger.plans.registry import big, q6, query, r6

col = F.col
K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
TYPES = ["click", "error", "purchase", "signup", "view"]
HOURS = 3_600_000_000


def frames(t):
    """Events as frames: seconds, k and a type number."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.array_position(F.array(*[F.lit(x) for x in TYPES]), col("event_type")).cast("double")
    return t.events.select("event_id", "user_id", "event_type", micros(col("ts")).alias("us"), "value", k.alias("k"), kind.alias("kind"))


FRAMES = f"fr AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value, {K_SQL} AS k, CAST(list_position({TYPES!r}, event_type) AS DOUBLE) AS kind FROM events)"


@query("lag_change", f"""
WITH {FRAMES}, l AS (SELECT *, lag(value) OVER w AS v0, lag(k) OVER w AS k0, lag(kind) OVER w AS t0 FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, {q6("coalesce((abs(value - v0) + abs(k - k0) + abs(kind - t0)) / 3, 0)")} AS change FROM l""")
def lag_change(t):
    d = frames(t).withColumn("vec", F.array("value", col("k").cast("double"), "kind"))
    return win.lag_change(d, ["user_id"], ["us", "event_id"], "vec").select("event_id", r6("change").alias("change"))


@query("rolling_outlier", f"""
WITH m AS (SELECT event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM events)
SELECT event_id, {q6("med")} AS rolling_median, coalesce(med > 0 AND abs(value - med) / med > 0.30, false) AS outlier FROM m""")
def rolling_outlier(t):
    d = win.rolling_outlier(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    return d.select("event_id", r6("rolling_median").alias("rolling_median"), "outlier")


@query("jump_fraction", f"""
WITH {FRAMES}, j AS (SELECT user_id, abs(value / 100 - lag(value / 100) OVER w) + abs(k / 100.0 - lag(k / 100.0) OVER w) + abs(kind / 5 - lag(kind / 5) OVER w) AS j FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, {q6("coalesce(avg((j > 0.55)::INT), 0)")} AS jump_fraction FROM j GROUP BY 1""")
def jump_fraction(t):
    d = frames(t).select("user_id", "us", "event_id", (col("value") / 100).alias("a"), (col("k") / 100.0).alias("b"), (col("kind") / 5).alias("c"))
    return win.jump_fraction(d, ["user_id"], ["us", "event_id"], ["a", "b", "c"]).select("user_id", r6("jump_fraction").alias("jump_fraction"))


@query("best_per_bin", f"""
WITH r AS (SELECT *, CAST(round_even(l_quantity / 50 / 0.05, 0) AS BIGINT) AS view_bin FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, view_bin ORDER BY l_extendedprice DESC, {LINE_SQL}) AS rn FROM r)
SELECT l_suppkey, view_bin, l_orderkey, {q6("l_extendedprice")} AS quality FROM n WHERE rn = 1""")
def per_bin(t):
    d = best_per_bin(t.lineitem, ["l_suppkey"], F.rint(col("l_quantity") / 50 / 0.05), [col("l_extendedprice").desc(), *LINE_ORDER])
    return d.select("l_suppkey", "view_bin", "l_orderkey", r6("l_extendedprice").alias("quality"))


@query("temporal_runs", f"""
WITH {FRAMES}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {8 * HOURS} THEN 1 ELSE 0 END AS nw FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT *, greatest(k / 50.0, 1e-6) AS a0, sum(nw) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
m AS (SELECT *, quantile_cont(greatest(a0, 1 / a0), 0.5) OVER (PARTITION BY user_id, run) AS med FROM r),
k AS (SELECT * FROM m WHERE abs(ln(greatest(a0, 1 / a0) / med)) <= 0.6),
s AS (SELECT user_id, run, count(*) AS n, count(*) FILTER (WHERE value > 10) AS st, quantile_cont(value, 0.5) AS q, max(us) - min(us) AS d, min(us) AS s0 FROM k GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (WHERE value > 10) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, st DESC, q DESC, d DESC, s0) AS rn FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, n AS "rows", st AS strict_rows, {q6("q")} AS median_score, d AS duration_us FROM o WHERE rn = 1""")
def temporal_runs(t):
    best, _ = win.stable_run(frames(t), ["user_id"], "us", ["event_id"], 8 * HOURS, col("k") / 50.0, col("value") > 10, "value", 3, 0.6)
    return best.select("user_id", "run", "rows", "strict_rows", r6("median_score").alias("median_score"), col("duration").alias("duration_us"))


_HIST = "\n".join(f"count(*) FILTER (WHERE event_type = '{x}') AS h{i}," for i, x in enumerate(TYPES))


@query("scene_cuts", f"""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sqrt(greatest(avg(value), 0) / 300) AS c0, sqrt(avg({K_SQL}) / 150) AS c1 FROM events GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, count(*) OVER (PARTITION BY user_id) AS n, epoch(day) - epoch(min(day) OVER (PARTITION BY user_id)) AS t,
  epoch(max(day) OVER (PARTITION BY user_id)) - epoch(min(day) OVER (PARTITION BY user_id)) AS dur FROM d),
h0 AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS c FROM events GROUP BY 1, 2, 3),
h AS (SELECT f.user_id, i, event_type, c / sqrt(sum(c * c) OVER (PARTITION BY f.user_id, i)) AS v FROM h0 JOIN f USING (user_id, day)),
a AS (SELECT x.user_id, x.i, sum(sqrt(x.v * y.v)) AS bc FROM h x JOIN h y ON x.user_id = y.user_id AND y.i = x.i + 1 AND x.event_type = y.event_type GROUP BY 1, 2),
s AS (SELECT user_id, i, sum(v) AS sv FROM h GROUP BY 1, 2),
b AS (SELECT f.user_id, f.i, event_type, sum(v) AS v FROM f JOIN h ON h.user_id = f.user_id AND h.i BETWEEN f.i - 2 AND f.i GROUP BY 1, 2, 3),
e AS (SELECT f.user_id, f.i, event_type, sum(v) AS v FROM f JOIN h ON h.user_id = f.user_id AND h.i BETWEEN f.i + 1 AND f.i + 3 GROUP BY 1, 2, 3),
x AS (SELECT b.user_id, b.i, sum(sqrt(b.v * e.v)) AS bc FROM b JOIN e USING (user_id, i, event_type) GROUP BY 1, 2),
bs AS (SELECT user_id, i, sum(v) AS sv FROM b GROUP BY 1, 2), es AS (SELECT user_id, i, sum(v) AS sv FROM e GROUP BY 1, 2),
r AS (SELECT f.user_id, f.day, f.i, f.n, g.t / greatest(f.dur, 1e-6) AS pos, sqrt(greatest(0, 1 - coalesce(a.bc, 0) / sqrt(s.sv * s2.sv))) AS hd, (abs(f.c0 - g.c0) + abs(f.c1 - g.c1)) / 2 AS cm,
  sqrt(greatest(0, 1 - coalesce(x.bc, 0) / sqrt(bs.sv * es.sv))) AS cd FROM f JOIN f g ON g.user_id = f.user_id AND g.i = f.i + 1 JOIN s ON s.user_id = f.user_id AND s.i = f.i JOIN s s2 ON s2.user_id = f.user_id AND s2.i = f.i + 1
  LEFT JOIN a ON a.user_id = f.user_id AND a.i = f.i LEFT JOIN x ON x.user_id = f.user_id AND x.i = f.i JOIN bs ON bs.user_id = f.user_id AND bs.i = f.i JOIN es ON es.user_id = f.user_id AND es.i = f.i WHERE f.n >= 6)
SELECT user_id, CAST(day AS VARCHAR) AS day, {q6("pos")} AS position, round(hd, 4) + 0.0 AS hist_distance, {q6("cm")} AS colour_mad, round(cd, 4) + 0.0 AS context_distance,
  CASE WHEN hd >= 0.72 AND cm >= 0.15 AND cd >= 0.4 THEN CASE WHEN pos BETWEEN 0.05 AND 0.95 OR (i >= 3 AND n - i >= 3) THEN 'cut' ELSE 'boundary' END END AS verdict FROM r""")
def scene_cuts(t):
    e = frames(t).withColumn("day", F.to_date(F.timestamp_micros("us")))
    d = e.groupBy("user_id", F.expr("CAST(us div 86400000000 AS INT)").alias("dn")).agg(
        F.array(*[F.count(F.when(col("event_type") == x, 1)).cast("double") for x in TYPES]).alias("hist"),
        F.array(F.sqrt(F.greatest(F.avg("value"), F.lit(0.0)) / 300), F.sqrt(F.avg("k") / 150)).alias("colour"))
    ends = d.groupBy("user_id").agg(F.min("dn").alias("d0"), F.max("dn").alias("d1"))
    d = d.join(ends, "user_id").withColumn("t", (col("dn") - col("d0")) * 86400.0).withColumn("dur", (col("d1") - col("d0")) * 86400.0)
    c = win.scene_cuts(d, ["user_id"], ["dn"], "t", col("dur"), "hist", "colour", colour_change=0.15, context=0.4)
    return c.select("user_id", F.date_from_unix_date("dn").cast("string").alias("day"), r6("position").alias("position"), (F.round("hist_distance", 4) + 0.0).alias("hist_distance"),
                    r6("colour_mad").alias("colour_mad"), (F.round("context_distance", 4) + 0.0).alias("context_distance"), "verdict")


@query("unwrap", f"""
WITH {FRAMES}, a AS (SELECT event_id, user_id, us, (us % 86400000000) / 240000000.0 AS a FROM fr),
d AS (SELECT *, a - lag(a) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM a),
w AS (SELECT *, CASE WHEN d IS NULL THEN a WHEN ((d + 180) % 360 + 360) % 360 - 180 = -180 AND d > 0 THEN 180 ELSE ((d + 180) % 360 + 360) % 360 - 180 END AS s FROM d)
SELECT event_id, CAST(round(sum(s) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) * 240000000) AS BIGINT) AS unwrapped_us FROM w""")
def unwrap(t):
    d = win.unwrap(frames(t), ["user_id"], ["us", "event_id"], (col("us") % 86400000000) / 240000000.0)
    return d.select("event_id", big(F.round(col("unwrapped") * 240000000)).alias("unwrapped_us"))


@query("loop_closure", f"""
WITH {FRAMES}, f AS (SELECT user_id, us, event_id, 1 - abs(k - first_value(k) OVER w) / 100.0 AS s, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
m AS (SELECT *, round((coalesce(lag(s, 2) OVER w, lag(s, 1) OVER w, s) + coalesce(lag(s, 1) OVER w, s) + s + coalesce(lead(s, 1) OVER w, s) + coalesce(lead(s, 2) OVER w, lead(s, 1) OVER w, s)) / 5, 12) AS z FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY z DESC, i) AS rn FROM m WHERE i >= least(greatest(round_even(0.6 * (n - 1), 0), 1), n - 1))
SELECT user_id, i AS closure_frame, {q6("z")} AS peak, z > 0.8 AS closed, {q6("least(greatest(CASE WHEN z > 0.8 THEN 360.0 * (n - 1) / i ELSE 240 END, 90), 400)")} AS sweep_degrees FROM t WHERE rn = 1""")
def loop_closure(t):
    f = frames(t)
    first = f.groupBy("user_id").agg(F.min_by("k", F.struct("us", "event_id")).alias("k0"))
    d = f.join(first, "user_id").withColumn("s", 1 - F.abs(col("k") - col("k0")) / 100.0)
    d = win.loop_closure(d, ["user_id"], ["us", "event_id"], "s", closure=0.8)
    return d.select("user_id", big("closure_frame").alias("closure_frame"), r6("peak").alias("peak"), "closed", r6("sweep_degrees").alias("sweep_degrees"))


@query("asof_interp", f"""
WITH {FRAMES}, a AS (SELECT user_id, us / 1e6 AS t, value AS az, CAST(k AS DOUBLE) AS el, lag(us / 1e6) OVER w AS pt, lag(value) OVER w AS pa, lead(us / 1e6) OVER w AS nt, lead(value) OVER w AS na FROM fr WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY us)),
r AS (SELECT event_id, user_id, us / 1e6 AS t FROM fr WHERE event_type <> 'error'),
j AS (SELECT r.*, lo.t AS lt, lo.az AS la, lo.el AS le, lo.pt AS lpt, lo.pa AS lpa, hi.t AS ht, hi.az AS ha, hi.el AS he, hi.nt AS hnt, hi.na AS hna
  FROM r ASOF LEFT JOIN a lo ON r.user_id = lo.user_id AND r.t >= lo.t ASOF LEFT JOIN a hi ON r.user_id = hi.user_id AND r.t <= hi.t)
SELECT event_id, round(CASE WHEN lt IS NULL THEN ha + least(greatest(coalesce((ha - hna) / (ht - hnt), 0) * (t - ht), -45), 45) WHEN ht IS NULL THEN la + least(greatest(coalesce((la - lpa) / (lt - lpt), 0) * (t - lt), -45), 45)
  ELSE la + CASE WHEN ht - lt > 0 THEN (t - lt) / (ht - lt) ELSE 0 END * (ha - la) END, 5) + 0.0 AS azimuth,
  round(CASE WHEN lt IS NULL THEN he WHEN ht IS NULL THEN le ELSE le + CASE WHEN ht - lt > 0 THEN (t - lt) / (ht - lt) ELSE 0 END * (he - le) END, 5) + 0.0 AS elevation,
  CASE WHEN lt IS NULL THEN 'before' WHEN ht IS NULL THEN 'after' ELSE 'inside' END AS side FROM j WHERE lt IS NOT NULL OR ht IS NOT NULL""")
def asof_interp(t):
    f = frames(t).withColumn("t", col("us") / 1e6).withColumn("azimuth", col("value")).withColumn("elevation", col("k").cast("double"))
    anchors, rows = f.where("event_type = 'error'"), f.where("event_type <> 'error'")
    d = win.interpolate_asof(rows.select("user_id", "t", "event_id"), anchors, ["user_id"], "t", ["event_id"], "azimuth", ["elevation"])
    return d.where("azimuth IS NOT NULL").select("event_id", (F.round("azimuth", 5) + 0.0).alias("azimuth"), (F.round("elevation", 5) + 0.0).alias("elevation"), "side")
