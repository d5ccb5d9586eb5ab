"""Queries for top-k, best-of and greedy selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.operators import selection as sel
from clipledger.operators.groups import top_k
from clipledger.plans.aggregates import LINE_ORDER, LINE_SQL
from clipledger.plans.gates import QUALITY_SQL, event_quality
from clipledger.plans.registry import big, joined, parts_sql, q6, query, r6, vector_parts
from clipledger.plans.windows import FRAMES, frames

col = F.col
KEYS, GAP = 8, 86400.0


@query("top_k", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, {LINE_SQL}) AS rn FROM lineitem)
SELECT l_partkey, rn, l_orderkey, {q6("l_extendedprice")} AS quality FROM r WHERE rn <= 8""")
def topk(t):
    d = top_k(t.lineitem, ["l_partkey"], [col("l_extendedprice").desc(), *LINE_ORDER], 8)
    return d.select("l_partkey", big("rn").alias("rn"), "l_orderkey", r6("l_extendedprice").alias("quality"))


@query("best_by", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, round(o_totalprice / 50000) DESC, o_orderdate, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, {q6("o_totalprice")} AS price FROM r WHERE rn = 1""")
def best_by(t):
    d = sel.best_by(t.orders, ["o_custkey"], [col("o_orderpriority"), F.round(col("o_totalprice") / 50000), -F.unix_date(F.to_date("o_orderdate")), col("o_orderkey")], ["o_orderkey", "o_totalprice"])
    return d.select("o_custkey", "o_orderkey", r6("o_totalprice").alias("price"))


def keyframe_frames(t):
    q = event_quality(t)
    kind = frames(t).select("event_id", "kind", (col("us") / 1e6).alias("t"))
    d = q.join(kind, "event_id")
    return d.withColumn("vec", F.array(col("value") / 100, col("k") / 100.0, col("kind") / 5))


@query("keyframes", f"""
WITH RECURSIVE {QUALITY_SQL},
fr AS (SELECT user_id, q, value / 100 AS a, k / 100.0 AS b, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) / 5 AS c, epoch_us(e.ts) / 1e6 AS t, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY e.ts, event_id) AS i FROM quality JOIN (SELECT event_id, event_type, ts FROM events) e USING (event_id)),
ds AS (SELECT x.user_id, greatest(quantile_cont((abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c)) / 3, 0.9), 1e-6) AS ds FROM fr x JOIN fr y ON x.user_id = y.user_id AND x.i < y.i GROUP BY 1),
g AS (SELECT user_id, least({KEYS}, count(*)) AS target, greatest((max(t) - min(t)) / greatest(1, least({KEYS}, count(*)) - 1), {GAP}, 1e-6) AS ts, max(ds) AS ds FROM fr JOIN ds USING (user_id) GROUP BY 1),
s AS (SELECT user_id, 0 AS r, [arg_min(i, (-q, i))] AS picks FROM (SELECT user_id, i, q FROM fr) GROUP BY 1
  UNION ALL
  SELECT user_id, r + 1, list_append(picks, i) FROM (
    SELECT c.user_id, c.r, c.picks, c.i, row_number() OVER (PARTITION BY c.user_id ORDER BY (c.dt + 1e-9 >= {GAP}) DESC, c.u DESC, c.i) AS rn FROM (
      SELECT z.user_id, z.r, z.picks, z.i, z.dt, round(0.58 * z.q + 0.27 * least(1, z.dv / g.ds) + 0.15 * least(1, z.dt / g.ts), 12) AS u FROM (
        SELECT s.user_id, s.r, s.picks, f.i, f.q, min(abs(f.t - p.t)) AS dt, min((abs(f.a - p.a) + abs(f.b - p.b) + abs(f.c - p.c)) / 3) AS dv
        FROM s JOIN fr f ON f.user_id = s.user_id AND NOT list_contains(s.picks, f.i) JOIN fr p ON p.user_id = s.user_id AND list_contains(s.picks, p.i) GROUP BY ALL) z
      JOIN g ON g.user_id = z.user_id AND z.r + 1 < g.target) c) WHERE rn = 1)
SELECT fr.user_id, fr.event_id, CAST(list_position(picks, i) - 1 AS BIGINT) AS selection_rank, {q6("q")} AS quality FROM (SELECT user_id, arg_max(picks, r) AS picks FROM s GROUP BY 1) JOIN fr USING (user_id) WHERE list_contains(picks, i)""")
def keyframes(t):
    d = sel.select_keyframes(keyframe_frames(t), ["user_id"], ["ts", "event_id"], "t", "quality", "vec", KEYS, GAP)
    return d.select("user_id", "event_id", big("selection_rank").alias("selection_rank"), r6("quality").alias("quality"))


@query("coverage_select", f"""
WITH RECURSIVE {FRAMES}, f AS (SELECT user_id, event_id, (us % 86400000000) / 240000000.0 AS az, k, value AS rms, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM fr),
s AS (SELECT user_id, 0 AS r, [arg_min(i, (-k, rms, i))] AS picks FROM f GROUP BY 1
  UNION ALL
  SELECT user_id, r + 1, list_append(picks, i) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (d >= 12) DESC, round(d, 12) DESC, k DESC, rms, i) AS rn FROM (
      SELECT s.user_id, s.r, s.picks, f.i, f.k, f.rms, min(least(abs(f.az - p.az), 360 - abs(f.az - p.az))) AS d
      FROM s JOIN f ON f.user_id = s.user_id AND NOT list_contains(s.picks, f.i) JOIN f p ON p.user_id = s.user_id AND list_contains(s.picks, p.i) WHERE s.r < 7 GROUP BY ALL)) WHERE rn = 1)
SELECT f.user_id, event_id, CAST(list_position(picks, i) - 1 AS BIGINT) AS selection_rank FROM (SELECT user_id, arg_max(picks, r) AS picks FROM s GROUP BY 1) JOIN f USING (user_id) WHERE list_contains(picks, i)""")
def coverage_select(t):
    f = frames(t).withColumn("az", (col("us") % 86400000000) / 240000000.0)
    d = sel.select_coverage(f, ["user_id"], ["us", "event_id"], "az", "k", "value", 8)
    return d.select("user_id", "event_id", big("selection_rank").alias("selection_rank"))


_VEC = "list_transform(embedding, lambda x: x::DOUBLE)"


@query("farthest_point", f"""
WITH RECURSIVE f AS (SELECT label, vec_id, {_VEC} AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
s AS (SELECT label, 0 AS r, [1::BIGINT] AS picks FROM f WHERE i = 1
  UNION ALL
  SELECT label, r + 1, list_append(picks, i) FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, i) AS rn FROM (
      SELECT s.label, s.r, s.picks, f.i, round(min(acos(least(greatest(list_dot_product(f.v, p.v), -1), 1))), 9) AS d
      FROM s JOIN f ON f.label = s.label AND NOT list_contains(s.picks, f.i) JOIN f p ON p.label = s.label AND list_contains(s.picks, p.i) WHERE s.r < 7 GROUP BY ALL)) WHERE rn = 1)
SELECT f.label, vec_id, CAST(list_position(picks, i) - 1 AS BIGINT) AS selection_rank FROM (SELECT label, arg_max(picks, r) AS picks FROM s GROUP BY 1) JOIN f USING (label) WHERE list_contains(picks, i)""")
def farthest_point(t):
    d = sel.farthest_point(t.embeddings, ["label"], "vec_id", "embedding", 8)
    return d.select("label", "vec_id", big("selection_rank").alias("selection_rank"))


def directions(t):
    """Unit directions from each three values of all embeddings."""
    x = [col("values")[i] for i in range(3)]
    n = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    return vector_parts(t, 3).select("label", "vec_id", "part", F.array(*[v / n for v in x]).alias("dir"))


DIRS = f"""dr AS (SELECT label, vec_id, part, v1 AS a, v2 AS b, v3 AS c, sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS n FROM {parts_sql(3)}),
du AS (SELECT label, vec_id, a / n AS x, b / n AS y, c / n AS z, row_number() OVER (PARTITION BY label ORDER BY vec_id, part) AS i, count(*) OVER (PARTITION BY label) AS cnt FROM dr)"""


@query("separated_count", f"""
WITH RECURSIVE {DIRS},
s AS (SELECT label, 1 AS i, max(cnt) AS n, [row(x, y, z)] AS kept FROM du WHERE i = 1 GROUP BY label, x, y, z
  UNION ALL
  SELECT s.label, s.i + 1, n, CASE WHEN len(list_filter(kept, lambda k: k[1] * d.x + k[2] * d.y + k[3] * d.z >= cos(radians(40)))) = 0 THEN list_append(kept, row(d.x, d.y, d.z)) ELSE kept END
  FROM s JOIN du d ON d.label = s.label AND d.i = s.i + 1)
SELECT label, CAST(len(kept) AS BIGINT) AS separated FROM s WHERE i = n""")
def separated_count(t):
    d = sel.separated_rows(directions(t), ["label"], ["vec_id", "part"], "dir", 40.0)
    return d.groupBy("label").agg(F.count("*").alias("separated"))


@query("priority_fallback", """
WITH c AS (SELECT o_custkey, o_orderpriority AS name, bool_or(o_totalprice > 450000) AS ok FROM orders GROUP BY 1, 2),
b AS (SELECT o_custkey, min(name) FILTER (WHERE ok) AS best, string_agg(name || ':no_large_order', ',' ORDER BY name) FILTER (WHERE NOT ok) AS why FROM c GROUP BY 1)
SELECT o_custkey, coalesce(best, 'needs_recapture') AS selected, CASE WHEN best IS NULL THEN coalesce(why, '') ELSE '' END AS reasons FROM b""")
def priority_fallback(t):
    c = t.orders.groupBy("o_custkey", col("o_orderpriority").alias("name")).agg(F.bool_or(col("o_totalprice") > 450000).alias("ok"))
    d = sel.select_candidate(c, ["o_custkey"], "name", col("name"), col("ok"), F.concat("name", F.lit(":no_large_order")))
    return d.select("o_custkey", "selected", joined("reasons").alias("reasons"))


SAMPLE_FPS, SOURCE_FPS, MAX_N = 1 / 21600, 1 / 26500, 60


@query("cadence", f"""
WITH RECURSIVE {FRAMES}, f AS (SELECT user_id, event_id, (us - min(us) OVER (PARTITION BY user_id)) / 1e6 AS t, (max(us) OVER (PARTITION BY user_id) - min(us) OVER (PARTITION BY user_id)) / 1e6 AS dur,
  row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM fr),
g AS (SELECT *, 1 / least({SAMPLE_FPS!r}, {MAX_N} / greatest(dur, 1e-6)) AS step FROM f),
s AS (SELECT user_id, 0 AS i, 0.0::DOUBLE AS nxt, 0 AS n, NULL::BIGINT AS event_id FROM f GROUP BY 1
  UNION ALL
  SELECT s.user_id, CAST(g.i AS INTEGER), CASE WHEN hit THEN greatest(round((s.nxt + g.step) / g.step), floor(g.t / g.step) + 1) * g.step ELSE s.nxt END, s.n + hit::INT, CASE WHEN hit THEN g.event_id END
  FROM (SELECT s.*, g.t + {0.5 / SOURCE_FPS!r} >= s.nxt AND s.n < {MAX_N} AS hit FROM s JOIN g ON g.user_id = s.user_id AND g.i = s.i + 1) s JOIN g ON g.user_id = s.user_id AND g.i = s.i + 1)
SELECT user_id, event_id, CAST(n - 1 AS BIGINT) AS candidate_index FROM s WHERE event_id IS NOT NULL""")
def cadence(t):
    f = frames(t)
    ends = f.groupBy("user_id").agg(F.min("us").alias("u0"), ((F.max("us") - F.min("us")) / 1e6).alias("dur"))
    d = f.join(ends, "user_id").withColumn("t", (col("us") - col("u0")) / 1e6)
    d = sel.sample_cadence(d, ["user_id"], "t", ["event_id"], SAMPLE_FPS, SOURCE_FPS, MAX_N, col("dur"))
    return d.select("user_id", "event_id", big("candidate_index").alias("candidate_index"))
