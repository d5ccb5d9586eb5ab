"""Queries for classifiers on feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.functions import arrays
from clipledger.operators import models as md
from clipledger.plans.registry import big, codes_sql, joined, q6, query, r6
from clipledger.session import settle

col = F.col
# Object families, in class order.
FAMILIES = ["planar", "rounded_slab", "rectangular_prism", "cylinder", "bottle", "revolved", "free_form", "other_a", "other_b", "other_c"]


def centroid_model(t):
    """A model whose class weights are the standardised class centroids of the embeddings."""
    e = t.embeddings
    scale = md.feature_scale(e, "embedding")
    z = e.withColumn("_s", scale.select(F.struct("mean", "scale")).scalar()).select("label", md.standardise(col("embedding"), col("_s.mean"), col("_s.scale")).alias("z"))
    sup = md.class_support(z, "label", "z")
    rows = md.support_arrays(sup, "label")
    m = scale.withColumn("_c", rows.select(F.struct("centroids", "p99", "reject")).scalar())
    return settle(m.select(F.array(*[F.lit(f) for f in FAMILIES]).alias("families"), "mean", "scale", col("_c.centroids").alias("weights"), F.array_repeat(F.lit(0.0), len(FAMILIES)).alias("bias"), F.lit(8.0).alias("temperature"), "_c.centroids", "_c.p99", "_c.reject"))


BASE = """ex AS MATERIALIZED (SELECT vec_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
st AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-5 THEN 1 ELSE stddev_pop(v) END AS s FROM ex GROUP BY 1),
nz AS MATERIALIZED (SELECT vec_id, label, ex.i, (v - m) / s AS z FROM ex JOIN st USING (i)), ce AS MATERIALIZED (SELECT label, i, avg(z) AS c FROM nz GROUP BY 1, 2),
ds AS (SELECT vec_id, nz.label, avg((z - c) * (z - c)) AS d FROM nz JOIN ce ON ce.label = nz.label AND ce.i = nz.i GROUP BY 1, 2),
su AS MATERIALIZED (SELECT label, quantile_cont(d, 0.99) AS p99, greatest(quantile_cont(d, 0.99) * 4, quantile_cont(d, 0.99) + 5) AS reject FROM ds GROUP BY 1),
lg AS MATERIALIZED (SELECT vec_id, nz.label, ce.label AS cls, sum(z * c) AS s FROM nz JOIN ce USING (i) GROUP BY 1, 2, 3)"""


@query("class_support", f"WITH {BASE}, c1 AS (SELECT label, sqrt(sum(c * c)) AS n FROM ce GROUP BY 1) SELECT label, {q6('n')} AS centroid_norm, {q6('p99')} AS p99, {q6('reject')} AS reject FROM su JOIN c1 USING (label)")
def class_support(t):
    m = centroid_model(t)
    z = F.posexplode(F.arrays_zip("centroids", "p99", "reject")).alias("label", "r")
    return m.select(z).select(col("label"), r6(arrays.norm("r.centroids")).alias("centroid_norm"), r6("r.p99").alias("p99"), r6("r.reject").alias("reject"))


@query("score_linear", f"WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS rn FROM lg) SELECT vec_id, cls AS best_class, {q6('s')} AS score FROM r WHERE rn = 1")
def score_linear(t):
    d = md.score_linear(t.embeddings, "embedding", centroid_model(t))
    return d.select("vec_id", arrays.argmax("scores").alias("best_class"), r6(F.array_max("scores")).alias("score"))


CLASS_SQL = f"""{BASE}, th AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS t FROM embeddings),
so AS (SELECT lg.vec_id, lg.label, cls, exp(s / 8 - max(s / 8) OVER (PARTITION BY lg.vec_id)) AS e, t FROM lg JOIN th USING (vec_id)),
sm AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p0 FROM so),
ve AS (SELECT *, CASE WHEN (cls = 0 AND t > 0.06) OR (cls = 1 AND NOT t BETWEEN 0.025 AND 0.55) OR (cls = 2 AND t < 0.05) THEN 0 ELSE p0 END AS p1 FROM sm),
pr AS MATERIALIZED (SELECT vec_id, label, cls, t, CASE WHEN sum(p1) OVER (PARTITION BY vec_id) > 0 THEN p1 / sum(p1) OVER (PARTITION BY vec_id) ELSE p1 END AS p FROM ve),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls DESC) AS rn FROM pr),
b1 AS (SELECT a.vec_id, a.label, a.cls, a.t, a.p AS conf, a.p - b.p AS margin, b.cls AS second, c.cls AS third FROM rk a JOIN rk b ON b.vec_id = a.vec_id AND b.rn = 2 JOIN rk c ON c.vec_id = a.vec_id AND c.rn = 3 WHERE a.rn = 1),
cl AS MATERIALIZED (SELECT b1.*, (SELECT avg((z - c) * (z - c)) FROM nz JOIN ce ON ce.i = nz.i AND ce.label = b1.cls WHERE nz.vec_id = b1.vec_id) AS dist, p99, reject FROM b1 JOIN su ON su.label = b1.cls)"""
_FAM = str(FAMILIES)


def classified(t):
    return md.classify(t.embeddings, "embedding", F.abs(col("embedding")[0].cast("double")), centroid_model(t))


@query("classify", f"""
WITH {CLASS_SQL} SELECT vec_id, list_extract({_FAM}, cls + 1) AS predicted, {q6("conf")} AS confidence, {q6("margin")} AS margin,
  list_extract({_FAM}, cls + 1) || ',' || list_extract({_FAM}, second + 1) || ',' || list_extract({_FAM}, third + 1) AS top3, {q6("dist")} AS training_distance, {q6("reject")} AS reject_distance FROM cl""")
def classify(t):
    d = classified(t)
    return d.select("vec_id", "predicted", *[r6(c).alias(c) for c in ("confidence", "margin")], joined(F.transform("alternatives", lambda a: a["family"])).alias("top3"), r6("training_distance").alias("training_distance"), r6("reject_distance").alias("reject_distance"))


@query("classifier_eval", f"""
WITH {CLASS_SQL}, e AS (SELECT cl.vec_id, cl.label, (cl.cls = cl.label)::INT AS ok, ln(greatest(p, 1e-9)) AS lp FROM cl JOIN pr ON pr.vec_id = cl.vec_id AND pr.cls = cl.label)
SELECT CAST(label AS VARCHAR) AS family, count(*) AS "rows", {q6("avg(ok)")} AS accuracy, {q6("-avg(lp)")} AS nll FROM e GROUP BY 1 UNION ALL SELECT NULL, count(*), {q6("avg(ok)")}, {q6("-avg(lp)")} FROM e""")
def classifier_eval(t):
    d = classified(t).withColumn("_i", F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), col("predicted")) - 1)
    e = md.evaluate_classifier(d, col("label"), col("_i"), "probabilities", "label")
    return e.select("family", "rows", r6("accuracy").alias("accuracy"), r6("nll").alias("nll"))


_GATE = codes_sql(
    ("too_few_valid_masks", "vm < 8"), ("too_few_view_clusters", "vc < 4 AND NOT turn"), ("rotation_not_confirmed", "vc < 4 AND turn AND NOT rot"), ("masks_touch_border", "e4 > 0.35"), ("low_probability", "conf < 0.72"),
    ("low_margin", "margin < 0.2"), ("low_agreement", "0.5 + e5 < 0.75"), ("outside_training_support", "dist > reject"), ("missing_face_or_edge_views", "prism AND (fv < 1 OR ev < 1 OR e7 < 0.2)"),
    ("too_thick_for_planar", "cls = 0 AND t > 0.06"), ("thickness_outside_slab", "cls = 1 AND NOT t BETWEEN 0.025 AND 0.55"), ("too_thin_for_prism", "cls = 2 AND t < 0.05"), ("significant_holes", "e8 > 0.05"),
    ("detached_components", "1 - e9 < 0.75"), ("temporal_jumps", "e10 > 0.35"))


@query("route_gate", f"""
WITH {CLASS_SQL}, ev AS (SELECT vec_id, {", ".join(f"abs(embedding[{i}]::DOUBLE) AS e{i}" for i in range(2, 11))} FROM embeddings),
g AS (SELECT cl.*, ev.* EXCLUDE (vec_id), floor(4 + e2 * 100) AS vm, floor(2 + e3 * 50) AS vc, floor(e6 * 20) AS fv, floor(e7 * 20) AS ev, cls IN (3, 4, 5) AS turn, cls IN (0, 1, 2) AS prism, embedding[11] > 0 AS rot FROM cl JOIN ev USING (vec_id) JOIN embeddings USING (vec_id))
SELECT vec_id, {_GATE} AS reasons, {codes_sql(("beyond_training_p99", "dist <= reject AND dist > p99", True), ("confirm_orbit_coverage", "vc < 4 AND turn", True), ("object_specific_masks", "vec_id % 3 = 1", True), ("unknown_mask_provenance", "vec_id % 3 = 0", True), ("no_independent_calibration", "true", True))} AS warnings,
  CASE WHEN {_GATE} = '' THEN list_extract({_FAM}, cls + 1) ELSE 'unknown' END AS family, 'review' AS decision,
  CASE WHEN {_GATE} = '' THEN map {{{", ".join(f"'{k}': '{v}'" for k, v in md.BUILDERS.items())}}}[list_extract({_FAM}, cls + 1)] END AS builder FROM g""")
def route_gate(t):
    e = {i: F.abs(col("embedding")[i - 1].cast("double")) for i in range(2, 11)}
    d = classified(t).withColumns({
        "valid_masks": F.floor(4 + e[2] * 100), "view_clusters": F.floor(2 + e[3] * 50), "clipped_fraction": e[4], "agreement": 0.5 + e[5], "face_views": F.floor(e[6] * 20), "edge_views": F.floor(e[7] * 20), "aspect_view_range": e[7],
        "maximum_hole_fraction": e[8], "minimum_dominance": 1 - e[9], "jump_fraction": e[10], "rotation_confirmed": col("embedding")[10] > 0, "thickness": F.abs(col("embedding")[0].cast("double"))})
    masks = F.when(col("vec_id") % 3 == 1, "object_specific").when(col("vec_id") % 3 == 2, "automatic")
    return md.route_gate(d, masks).select("vec_id", joined("reasons").alias("reasons"), joined("warnings").alias("warnings"), "family", "decision", "builder")


_PRED = "CASE WHEN quantile_cont(d, 0.5) > 0.051 THEN 'high' WHEN quantile_cont(x, 0.5) > 0.041 THEN 'taxed' WHEN quantile_cont(d, 0.1) < 0.012 THEN 'wide' ELSE 'low' END"
_REP = "row_number() OVER (PARTITION BY {k}, CAST(round_even(a / 0.05, 0) AS BIGINT) ORDER BY q DESC, id)"


@query("bootstrap", f"""
WITH v AS MATERIALIZED (SELECT k, id, max(q) AS q, max(a) AS a, max(d) AS d, max(x) AS x FROM (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 100000 AS q, l_quantity / 50 AS a, l_discount AS d, l_tax AS x FROM lineitem) GROUP BY 1, 2 HAVING max(q) >= 0.2),
r AS MATERIALIZED (SELECT * FROM (SELECT *, {_REP.format(k="k")} AS rn FROM v) WHERE rn = 1),
n AS (SELECT v.k, count(*) AS nv, max(nr) AS nr FROM v JOIN (SELECT k, count(*) AS nr FROM r GROUP BY 1) USING (k) GROUP BY 1),
w AS MATERIALIZED (SELECT k, {_PRED} AS pw FROM r GROUP BY 1),
p AS (SELECT r.k, id, q, a, d, x, nr AS sz FROM r JOIN n USING (k) WHERE nr >= 4 AND nv >= 8 UNION ALL SELECT v.k, id, q, a, d, x, nv FROM v JOIN n USING (k) WHERE nr < 4 AND nv >= 8),
t AS (SELECT p.*, tr, row_number() OVER (PARTITION BY k, tr ORDER BY sha256('agreement-1|' || tr || '|' || id), id) AS i FROM p, range(16) g(tr)),
s AS (SELECT *, {_REP.format(k="k, tr")} AS rn FROM t WHERE i <= CASE WHEN sz >= 4 THEN least(greatest(3, ceil(0.75 * sz)), sz - 1) ELSE greatest(3, ceil(0.75 * sz)) END),
e AS (SELECT k, tr, {_PRED} AS pt FROM s WHERE rn = 1 GROUP BY 1, 2), m AS (SELECT k, avg((pt = pw)::INT) AS ag FROM e JOIN w USING (k) GROUP BY 1)
SELECT k AS l_suppkey, pw AS predicted, {q6("coalesce(ag, 0)")} AS agreement FROM w LEFT JOIN m USING (k)""")
def bootstrap(t):
    li = t.lineitem.select("l_suppkey", (col("l_orderkey") * 10 + col("l_linenumber")).alias("id"), (col("l_extendedprice") / 100000).alias("q"), (col("l_quantity") / 50).alias("a"), col("l_discount").alias("d"), col("l_tax").alias("x"))
    f = li.groupBy("l_suppkey", "id").agg(*[F.max(c).alias(c) for c in "qadx"]).withColumn("rounded", F.lit(False))

    def predict(c):
        return c.withColumn("predicted", F.when(col("d_q50") > 0.051, "high").when(col("x_q50") > 0.041, "taxed").when(col("d_q10") < 0.012, "wide").otherwise("low"))

    d = md.subset_agreement(f, ["l_suppkey"], "id", "q", "a", ["d", "x"], "rounded", predict)
    return d.select("l_suppkey", "predicted", r6("agreement").alias("agreement"))


@query("kmeans")
def kmeans(t):
    """Two clusters of the embeddings with their representatives."""
    e = t.embeddings.withColumn("q", F.abs(col("embedding")[0].cast("double")))
    _, best = md.cluster_faces(e, "embedding", "q", ["vec_id"])
    return best.select("cluster", big("size").alias("size"), "vec_id")


@query("train")
def train(t):
    """Softmax trained on the embeddings whose hash falls into the training share, with its evaluation on the rest."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(5))
    e = t.embeddings.withColumn("_part", part)
    model = settle(md.train_softmax(e.where("_part < 3"), "label", "embedding", FAMILIES, e.where("_part = 3")))
    d = md.classify(e.where("_part = 4"), "embedding", F.lit(0.05), model)
    d = d.withColumn("_i", F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), col("predicted")) - 1)
    r = md.evaluate_classifier(d, col("label"), col("_i"), "probabilities", "label")
    return r.select("family", "rows", F.round("accuracy", 3).alias("accuracy"), F.round("nll", 2).alias("nll"))
