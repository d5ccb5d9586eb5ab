"""Queries for graph and iterative operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clipledger.functions import arrays
from clipledger.operators import graph as gr
from clipledger.operators.groups import by_group
from clipledger.operators.selection import best_by
from clipledger.plans.registry import big, codes_sql, joined, q6, query, r6
from clipledger.plans.windows import FRAMES, HOURS, frames
from clipledger.session import join_same, settle, spread_groups

col = F.col


PARTS = 10**9  # parts as nodes count from here: the order of numbers is that of the names, which have nine digits


def customer_part(t):
    """Edges between customers and the parts they ordered, as numbers (see :func:`node_name`); an edge for each line, as
    repeated ones change nothing in what components and levels are, and few lines repeat one."""
    # packed small, lines need much memory when sorted: tasks are as many as the session names, whatever their bytes
    li = spread_groups(t.lineitem.select("l_orderkey", "l_partkey"), ["l_orderkey"])
    o = t.orders.select(col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return li.join(o, "l_orderkey").select(big("o_custkey").alias("src"), (big("l_partkey") + PARTS).alias("dst"))


def node_name(c):
    """c… for customers, p… for parts."""
    return F.concat(F.when(c < PARTS, "c").otherwise("p"), F.lpad((c % PARTS).cast("string"), 9, "0"))


_GRAPH = """ed AS MATERIALIZED (SELECT DISTINCT 'c' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS src, 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
bi AS MATERIALIZED (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed)"""


@query("components", f"""
WITH RECURSIVE {_GRAPH},
cc(node, comp) USING KEY (node) AS (SELECT src, min(least(src, dst)) FROM bi GROUP BY 1 UNION SELECT * FROM (SELECT bi.dst AS node, min(cc.comp) AS comp FROM cc JOIN bi ON bi.src = cc.node JOIN recurring.cc r ON r.node = bi.dst WHERE cc.comp < r.comp GROUP BY 1))
SELECT comp AS component, count(*) AS size, {q6("count(*) / (SELECT count(*) FROM cc)")} AS dominance, comp = (SELECT comp FROM cc GROUP BY 1 ORDER BY count(*) DESC, comp LIMIT 1) AS largest FROM cc GROUP BY 1""")
def components(t):
    d = gr.component_stats(gr.components(customer_part(t)))
    return d.select(node_name(col("component")).alias("component"), "size", r6("dominance").alias("dominance"), "largest")


_LAB = """lb AS MATERIALIZED (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS node, CAST(c_nationkey % 5 AS INT) AS label FROM customer UNION ALL SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), CAST(p_size % 5 AS INT) FROM part)"""


def node_labels(t):
    c = t.customer.select(big("c_custkey").alias("node"), (col("c_nationkey") % 5).cast("int").alias("label"))
    return c.unionByName(t.part.select((big("p_partkey") + PARTS).alias("node"), (col("p_size") % 5).cast("int").alias("label")))


@query("charts", f"""
WITH RECURSIVE {_GRAPH}, {_LAB},
se AS MATERIALIZED (SELECT bi.* FROM bi JOIN lb x ON x.node = src JOIN lb y ON y.node = dst WHERE x.label = y.label),
cc(node, comp) USING KEY (node) AS (SELECT src, min(least(src, dst)) FROM se GROUP BY 1 UNION SELECT * FROM (SELECT se.dst AS node, min(cc.comp) AS comp FROM cc JOIN se ON se.src = cc.node JOIN recurring.cc r ON r.node = se.dst WHERE cc.comp < r.comp GROUP BY 1)),
a AS (SELECT label, coalesce(comp, lb.node) AS chart FROM lb LEFT JOIN cc ON cc.node = lb.node)
SELECT label, count(DISTINCT chart) AS charts, (SELECT max(n) FROM (SELECT count(*) AS n FROM a b WHERE b.label = a.label GROUP BY chart)) AS largest FROM a GROUP BY 1""")
def charts(t):
    d = gr.charts(node_labels(t), customer_part(t)).groupBy("label", "chart").agg(F.count("*").alias("n"))
    return d.groupBy("label").agg(F.count("*").alias("charts"), F.max("n").alias("largest"))


@query("bfs", f"""
WITH RECURSIVE {_GRAPH}, {_LAB},
w(node, level) USING KEY (node) AS (SELECT src, 0 FROM (SELECT DISTINCT src FROM ed) JOIN customer ON src = 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHERE c_acctbal > 9800
  UNION SELECT bi.dst, min(w.level) + 1 FROM w JOIN bi ON bi.src = w.node WHERE bi.dst NOT IN (SELECT node FROM recurring.w) GROUP BY 1)
SELECT w.node, CAST(level AS INT) AS level FROM w JOIN lb ON lb.node = w.node WHERE lb.label = 2 AND level > 0 AND level = (SELECT min(level) FROM w JOIN lb ON lb.node = w.node WHERE lb.label = 2 AND level > 0)""")
def bfs(t):
    e = customer_part(t)
    rich = t.customer.where("c_acctbal > 9800").select(big("c_custkey").alias("node"))
    seeds = e.select(col("src").alias("node")).distinct().join(rich, "node", "left_semi")
    return gr.nearest_labelled(e, seeds, node_labels(t).where("label = 2")).select(node_name(col("node")).alias("node"), "level")


@query("adjacency", """
WITH f AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS f FROM lineitem) SELECT DISTINCT a.f AS src, b.f AS dst FROM f a JOIN f b ON a.e = b.e AND a.f <> b.f""")
def adjacency(t):
    return part_neighbours(t).select("src", "dst")


def part_neighbours(t):
    """Parts as faces that meet in the orders that hold them."""
    return gr.face_neighbours(t.lineitem, [], "l_partkey", ["l_orderkey"])


_ADJ = """f AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS f FROM lineitem), nb AS MATERIALIZED (SELECT DISTINCT a.f AS src, b.f AS dst FROM f a JOIN f b ON a.e = b.e AND a.f <> b.f)"""


def _smooth_round(i):
    return f"""v{i} AS (SELECT nb.src AS node, label, count(*) AS k FROM nb JOIN l{i} ON l{i}.node = nb.dst GROUP BY 1, 2),
l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT sc.node, sc.label, row_number() OVER (PARTITION BY sc.node ORDER BY round(score + coalesce(0.12 * k / deg, 0), 9) DESC, sc.label) AS rn FROM sc LEFT JOIN dg USING (node) LEFT JOIN v{i} v ON v.node = sc.node AND v.label = sc.label) WHERE rn = 1)"""


@query("smooth_labels", f"""
WITH {_ADJ}, sc AS MATERIALIZED (SELECT l_partkey AS node, l_returnflag AS label, round(avg(l_quantity) / 500, 9) AS score FROM lineitem GROUP BY 1, 2), dg AS (SELECT src AS node, count(*) AS deg FROM nb GROUP BY 1),
l0 AS MATERIALIZED (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, label) AS rn FROM sc) WHERE rn = 1), {_smooth_round(0)}, {_smooth_round(1)}
SELECT node, label FROM l2""")
def smooth_labels(t):
    s = t.lineitem.groupBy(col("l_partkey").alias("node"), col("l_returnflag").alias("label")).agg(F.round(F.avg("l_quantity") / 500, 9).alias("score"))
    return gr.smooth_labels(s, part_neighbours(t)).select("node", "label")


@query("smooth_in_order", """
WITH RECURSIVE sc AS (SELECT l_suppkey AS f, CAST(l_linenumber % 4 AS INTEGER) AS label, avg(CAST(l_quantity AS DOUBLE)) AS score FROM lineitem GROUP BY 1, 2),
b0 AS (SELECT f, min(struct_pack(c := -score, l := label)) AS b FROM sc GROUP BY 1), lam AS (SELECT 0.15 * median(-(b.c)) AS w FROM b0),
num AS (SELECT f, row_number() OVER (ORDER BY f) AS i FROM b0), n AS (SELECT count(*) AS n FROM num),
e0 AS (SELECT DISTINCT a.s_suppkey AS u, b.s_suppkey AS v FROM supplier a JOIN supplier b ON b.s_suppkey IN (a.s_suppkey * 2, a.s_suppkey * 3)),
nb AS (SELECT x.i, list(y.i) AS ns FROM (SELECT u, v FROM e0 WHERE u <> v UNION SELECT v, u FROM e0 WHERE u <> v) e JOIN num x ON x.f = e.u JOIN num y ON y.f = e.v GROUP BY 1),
sn AS (SELECT i, label, score, coalesce(ns, []) AS ns FROM sc JOIN num USING (f) LEFT JOIN nb USING (i)),
r AS (SELECT CAST(0 AS BIGINT) AS k, list(b.l ORDER BY f) AS ls FROM b0
  UNION ALL SELECT r.k + 1, list_concat(list_concat(r.ls[1:r.k % n], [min(struct_pack(c := -score + w * CAST(len(list_filter(ns, lambda j: r.ls[j] <> label)) AS DOUBLE), l := label)).l]), r.ls[r.k % n + 2:n])
  FROM r, n, lam, sn WHERE sn.i = r.k % n + 1 AND r.k < 3 * n GROUP BY r.k, r.ls, n, w)
SELECT num.f AS node, ls[num.i] AS label FROM r, n, num WHERE r.k = 3 * n""")
def smooth_in_order(t):
    """Suppliers as faces, with a score for each of four labels, next to four others at most."""
    scores = t.lineitem.groupBy(col("l_suppkey").alias("node"), (col("l_linenumber") % 4).cast("int").alias("label")).agg(F.avg(col("l_quantity").cast("double")).alias("score"))
    s = t.supplier.select(col("s_suppkey").alias("src"))
    e = s.withColumn("dst", F.explode(F.array(col("src") * 2, col("src") * 3))).join(s.withColumnRenamed("src", "dst"), "dst", "left_semi").where("src != dst")
    both = e.select("src", "dst").unionByName(e.select(col("dst").alias("src"), col("src").alias("dst")))
    return gr.smooth_in_order(scores, both.join(scores.select(col("node").alias("dst")).distinct(), "dst", "left_semi"), sweeps=3).select("node", "label")


def _taubin_step(i, k):
    return f"s{i + 1} AS MATERIALIZED (SELECT s{i}.node, v + ({k}) * coalesce(m - v, 0) AS v FROM s{i} LEFT JOIN (SELECT src AS node, avg(v) AS m FROM nb JOIN s{i} ON s{i}.node = dst GROUP BY 1) a ON a.node = s{i}.node)"


@query("taubin", f"""
WITH {_ADJ}, s0 AS (SELECT p_partkey AS node, p_retailprice AS v FROM part), {", ".join(_taubin_step(i, 0.45 if i % 2 == 0 else -0.47) for i in range(4))}
SELECT node, {q6("v")} AS price FROM s4""")
def taubin(t):
    d = gr.taubin(t.part.select(col("p_partkey").alias("node"), col("p_retailprice").alias("v")), part_neighbours(t), ["v"], rounds=2)
    return d.select("node", r6("v").alias("price"))


def _offset_round(i):
    """One round of conjugate gradients as CTEs: s{i}(node, g, r, p) → s{i + 1}."""
    return f"""ap{i} AS MATERIALIZED (SELECT node, coalesce(sum(t), 0) AS ap FROM (SELECT a.node, w * (a.p - b.p) AS t FROM oe JOIN s{i} a ON a.node = oe.a JOIN s{i} b ON b.node = oe.b UNION ALL SELECT b.node, w * (b.p - a.p) FROM oe JOIN s{i} a ON a.node = oe.a JOIN s{i} b ON b.node = oe.b) GROUP BY 1),
x{i} AS MATERIALIZED (SELECT s.*, ap + 0.01 * p AS ap FROM s{i} s JOIN ap{i} USING (node)),
al{i} AS MATERIALIZED (SELECT coalesce(sum(r * r) / nullif(sum(p * ap), 0), 0) AS al, sum(r * r) AS rr FROM x{i}),
y{i} AS MATERIALIZED (SELECT node, g + al * p AS g, r - al * ap AS r, p, rr FROM x{i}, al{i}),
s{i + 1} AS MATERIALIZED (SELECT node, g, r, r + coalesce((SELECT sum(r * r) FROM y{i}) / nullif(rr, 0), 0) * p AS p FROM y{i})"""


OFFSET_ROUNDS = 40


@query("level_offsets", f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS brand, p_retailprice AS price FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT brand, price, lead(brand) OVER w AS nb, lead(price) OVER w AS np FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
oe AS MATERIALIZED (SELECT least(brand, nb) AS a, greatest(brand, nb) AS b, avg(CASE WHEN brand < nb THEN price - np ELSE np - price END) AS diff, count(*)::DOUBLE AS w FROM n WHERE nb <> brand GROUP BY 1, 2),
s0 AS MATERIALIZED (SELECT node, 0.0::DOUBLE AS g, sum(r) AS r, sum(r) AS p FROM (SELECT a AS node, w * diff AS r FROM oe UNION ALL SELECT b, -w * diff FROM oe) GROUP BY 1),
{", ".join(_offset_round(i) for i in range(OFFSET_ROUNDS))}
SELECT node, round(g, 4) + 0.0 AS "offset" FROM s{OFFSET_ROUNDS}""")
def level_offsets(t):
    """Brand offsets that reconcile price differences between neighbouring lines of an order."""
    b = t.part.select(col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("brand"), col("p_retailprice").alias("price"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = t.lineitem.join(b, "l_partkey").select("brand", "price", F.lead("brand").over(w).alias("nb"), F.lead("price").over(w).alias("np")).where("nb != brand")
    up = col("brand") < col("nb")
    diff = F.when(up, col("price") - col("np")).otherwise(col("np") - col("price"))
    e = li.groupBy(F.least("brand", "nb").alias("a"), F.greatest("brand", "nb").alias("b")).agg(F.avg(diff).alias("diff"), F.count("*").cast("double").alias("w"))
    return gr.level_offsets(e).select("node", (F.round("offset", 4) + 0.0).alias("offset"))


def _prune_round(i):
    return f"""m{i} AS MATERIALIZED (SELECT k, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS sp FROM p{i} WHERE op GROUP BY 1),
a{i} AS MATERIALIZED (SELECT p.*, 1 - abs(v - med) / greatest(sp, 1e-9) < 0.45 AS dr FROM p{i} p JOIN m{i} USING (k) WHERE op),
n{i} AS MATERIALIZED (SELECT k, count(*) FILTER (WHERE NOT dr) AS lf, count(*) FILTER (WHERE dr) AS gn FROM a{i} GROUP BY 1),
p{i + 1} AS MATERIALIZED (SELECT a.k, a.v, a.x, gn > 0 AND lf >= 10 AS op FROM a{i} a JOIN n{i} USING (k) WHERE NOT dr UNION ALL SELECT k, v, x, op FROM p{i} WHERE NOT op)"""


@query("prune", f"""
WITH p0 AS MATERIALIZED (SELECT l_suppkey AS k, l_extendedprice AS v, l_quantity AS x, count(*) OVER (PARTITION BY l_suppkey) >= 10 AS op FROM lineitem), {_prune_round(0)}, {_prune_round(1)}, {_prune_round(2)}
SELECT k AS l_suppkey, count(*) AS kept, {q6("min(v)")} AS low, {q6("max(v)")} AS high, count(*) >= 10 AS accepted FROM p3 GROUP BY 1""")
def prune(t):
    def agree(d):
        def step(d, g):
            return g.attach_quantiles(d, _m=(col("v"), 0.5), _a=(col("v"), 0.1), _b=(col("v"), 0.9))

        d = by_group(d, ["l_suppkey"], step)
        return d.withColumn("agreement", 1 - F.abs(col("v") - col("_m")) / F.greatest(col("_b") - col("_a"), F.lit(1e-9))).drop("_m", "_a", "_b")

    d = gr.prune(t.lineitem.select("l_suppkey", col("l_extendedprice").alias("v")), ["l_suppkey"], agree)
    return d.groupBy("l_suppkey").agg(F.count("*").alias("kept"), r6(F.min("v")).alias("low"), r6(F.max("v")).alias("high"), F.bool_and("accepted").alias("accepted"))


@query("orbit_fit", """
WITH v AS (SELECT l_suppkey AS k, l_quantity / 10 AS x, l_discount * 20 AS y, l_extendedprice / 40000 AS z FROM lineitem),
m AS (SELECT k, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM v GROUP BY 1),
n AS (SELECT *, (a + b + c) / 3 AS q FROM m), p AS (SELECT *, sqrt(((a-q)*(a-q) + (b-q)*(b-q) + (c-q)*(c-q) + 2*(d*d + e*e + f*f)) / 6) AS p FROM n),
r AS (SELECT *, q + 2*p*cos(acos(least(greatest((((a-q)/p) * (((b-q)/p) * ((c-q)/p) - (f/p)*(f/p)) - (d/p) * ((d/p) * ((c-q)/p) - (f/p)*(e/p)) + (e/p) * ((d/p)*(f/p) - ((b-q)/p)*(e/p))) / 2, -1), 1)) / 3 + 2*pi()/3) AS l FROM p),
o AS (SELECT *, [d*f - e*(b-l), e*d - (a-l)*f, (a-l)*(b-l) - d*d] AS n1, [d*(c-l) - e*f, e*e - (a-l)*(c-l), (a-l)*f - d*e] AS n2, [(b-l)*(c-l) - f*f, f*e - d*(c-l), d*f - (b-l)*e] AS n3 FROM r),
g AS (SELECT *, list_inner_product(n1, n1) AS w1, list_inner_product(n2, n2) AS w2, list_inner_product(n3, n3) AS w3 FROM o),
h AS (SELECT k, cx, cy, cz, CASE WHEN w1 >= w2 AND w1 >= w3 THEN n1 WHEN w2 >= w3 THEN n2 ELSE n3 END AS n, sqrt(greatest(w1, w2, w3)) AS w FROM g),
u AS (SELECT v.k, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)) AS r, ((x-cx)*n[1] + (y-cy)*n[2] + (z-cz)*n[3]) / w AS pn FROM v JOIN h USING (k))
SELECT k AS l_suppkey, round(avg(r), 5) AS radius, round(stddev_pop(degrees(atan2(pn, sqrt(greatest(r*r - pn*pn, 0))))), 5) AS elevation_spread, count(*) AS views FROM u GROUP BY 1""")
def orbit_fit(t):
    from clipledger.plans.aggregates import LINE_ORDER

    v = t.lineitem.select(*LINE_ORDER, (col("l_quantity") / 10).alias("x"), (col("l_discount") * 20).alias("y"), (col("l_extendedprice") / 40000).alias("z"))
    d = gr.orbit_fit(v, ["l_suppkey"], LINE_ORDER, "x", "y", "z")
    return d.groupBy("l_suppkey").agg(F.round(F.avg("radius"), 5).alias("radius"), F.round(F.stddev_pop("elevation"), 5).alias("elevation_spread"), F.count("*").alias("views"))


def _family(name, test, score, extra):
    """CTEs for one family: its best run, member spread and pick."""
    p = name[0]
    return f"""{p}f AS MATERIALIZED (SELECT * FROM fv WHERE {test}), {p}st AS (SELECT user_id, count(*) AS n, quantile_cont(mk, 0.5) AS m FROM {p}f GROUP BY 1),
{p}g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {30 * HOURS} THEN 1 ELSE 0 END AS nw FROM {p}f WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
{p}r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM {p}g),
{p}m AS (SELECT *, quantile_cont(ap, 0.5) OVER (PARTITION BY user_id, run) AS med FROM {p}r), {p}k AS MATERIALIZED (SELECT * FROM {p}m WHERE abs(ln(ap / med)) <= 0.6),
{p}s AS (SELECT user_id, run, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, count(*) FILTER (WHERE st) DESC, quantile_cont(sc, 0.5) DESC, max(us) - min(us) DESC, min(us)) AS rn FROM {p}k GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (WHERE st) > 0),
{p}b AS MATERIALIZED (SELECT k.* FROM {p}k k JOIN {p}s s ON s.user_id = k.user_id AND s.run = k.run AND s.rn = 1),
{p}n AS (SELECT user_id, count(*) AS sup FROM {p}b GROUP BY 1), {p}c AS (SELECT x.user_id, quantile_cont((abs(x.s1 - y.s1) + abs(x.s2 - y.s2)) / 2, 0.5) AS con FROM {p}b x JOIN {p}b y ON x.user_id = y.user_id AND x.event_id < y.event_id GROUP BY 1),
{p}p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round({score} - 0.05 * least(abs(ln(ap / med)) / 0.6, 1), 12) DESC, sc DESC, us) AS rn FROM {p}b WHERE st {extra})"""


@query("families", f"""
WITH {FRAMES}, fv AS MATERIALIZED (SELECT user_id, event_id, us, k / 100.0 AS mk, greatest(greatest(k / 50.0, 1e-6), 1 / greatest(k / 50.0, 1e-6)) AS ap, value > 5 AS st, value / 100 AS sc, value / 10 AS dt, 0.3 + k / 200.0 AS s2c, value / 300 AS s1, kind / 5 AS s2 FROM fr),
{_family("primary", "mk >= 0.6", "sc", "AND dt >= 1")}, {_family("secondary", "mk <= 0.4", "s2c", "")},
u AS (SELECT user_id, count(*) AS nv FROM fv GROUP BY 1),
z AS (SELECT u.user_id, nv, coalesce(pst.n, 0) AS pf, coalesce(sst.n, 0) AS sf, pst.m - sst.m AS sep, coalesce(pn.sup, 0) AS ps, coalesce(sn.sup, 0) AS ss, coalesce(pc.con, 1) AS pcon, coalesce(scn.con, 1) AS scon, pp.event_id AS pe, sp.event_id AS se,
  (abs(pp.s1 - sp.s1) + abs(pp.s2 - sp.s2)) / 2 AS dis FROM u LEFT JOIN pst USING (user_id) LEFT JOIN sst USING (user_id) LEFT JOIN pn USING (user_id) LEFT JOIN sn USING (user_id) LEFT JOIN pc USING (user_id) LEFT JOIN sc scn USING (user_id)
  LEFT JOIN (SELECT * FROM pp WHERE rn = 1) pp USING (user_id) LEFT JOIN (SELECT * FROM sp WHERE rn = 1) sp USING (user_id))
SELECT user_id, pe AS "primary", se AS secondary, ps AS primary_support, {q6("pcon")} AS primary_consensus, {q6("dis")} AS dissimilarity,
  {codes_sql(("too_few_views", "nv < 6"), ("unsupported_families", "pf < 3 OR sf < 3"), ("families_not_separated", "sep < 0.3"), ("no_stable_family_run", "ps = 0 OR ss = 0"), ("primary_consensus_too_low", "pcon > 0.25"), ("secondary_consensus_too_low", "scon > 0.25"), ("no_primary_view", "pe IS NULL"), ("no_secondary_view", "se IS NULL"), ("views_not_distinct", "dis < 0.1"))} AS reasons FROM z""")
def families(t):
    f = frames(t).select("user_id", "event_id", "us", (col("k") / 100.0).alias("mk"), (col("k") / 50.0).alias("asp"), "value", (col("value") / 100).alias("sc"), (col("value") / 10).alias("dt"), (0.3 + col("k") / 200.0).alias("s2c"), F.array(col("value") / 300, col("kind") / 5).alias("sil"))
    f = f.withColumn("app", col("sil"))
    d = gr.select_families(f, ["user_id"], "us", ["event_id"], marking="mk", aspect=col("asp"), strict=col("value") > 5, score="sc", detail="dt", secondary="s2c", silhouette="sil", appearance="app", gap=30 * HOURS,
                           limits={"marked": 0.6, "plain": 0.4, "consensus": 0.25, "detail": 1.0, "aspect": 0.6})
    return d.select("user_id", "primary", "secondary", "primary_support", r6("primary_consensus").alias("primary_consensus"), r6("dissimilarity").alias("dissimilarity"), joined("reasons").alias("reasons"))


@query("accept_completed", f"""
WITH {FRAMES}, v AS (SELECT user_id, event_id, k / 100.0 AS iou, value > 40 AS reg FROM fr), m AS (SELECT user_id, median(iou) FILTER (WHERE reg) AS m FROM v GROUP BY 1)
SELECT event_id, reg OR iou >= greatest(0.5, coalesce(0.7 * m, 0)) AS kept FROM v JOIN m USING (user_id)""")
def accept_completed(t):
    f = frames(t).select("user_id", "event_id", (col("k") / 100.0).alias("iou"), (col("value") > 40).alias("reg"))
    return gr.accept_completed(f, ["user_id"], "iou", col("reg")).select("event_id", "kept")


_TURN = lambda a: f"list_transform(range(16), lambda i: {a}[(i % 4) * 4 + (3 - i // 4) + 1])"
_FAR = lambda a: f"coalesce(1 - list_sum(list_transform(range(1, 17), lambda i: s1[i] & {a}[i]))::DOUBLE / nullif(list_sum(list_transform(range(1, 17), lambda i: s1[i] | {a}[i])), 0), 0)"


@query("aligned_consensus", f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding[1:16], lambda x: (x > 0)::INT) AS s FROM embeddings),
p AS (SELECT x.label, x.vec_id AS a, x.s AS s1, y.s AS r0, {_TURN("y.s")} AS r1 FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id), q AS (SELECT *, {_TURN("r1")} AS r2 FROM p), t AS (SELECT *, {_TURN("r2")} AS r3 FROM q)
SELECT label, {q6("median(least(" + ", ".join(_FAR(f"r{k}") for k in range(4)) + "))")} AS distance FROM t GROUP BY 1""")
def aligned_consensus(t):
    """Signs of 16 components as silhouettes of 4 by 4, compared in their best quarter turn within a label."""
    e = t.embeddings.select("vec_id", "label", F.transform(F.slice("embedding", 1, 16), lambda x: (x > 0).cast("double")).alias("s"), F.array(F.lit(1.0)).alias("a"))
    return gr.aligned_quantile(e, ["label"], "s", "a", 4, ["vec_id"], 0.5, "distance").select("label", r6("distance").alias("distance"))
