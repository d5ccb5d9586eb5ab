"""Queries for readers, generators and predictors."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clipledger.functions import tables
from clipledger.operators import predict as pr
from clipledger.operators.lineage import array_hash
from clipledger.operators.surfaces import voxel_grid
from clipledger.plans.registry import big, codes_sql, joined, q6, query, r6
from clipledger.session import checkpoint_folder
from clipledger.sources import readers as rd
from clipledger.sources import sinks

col = F.col
K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@query("media_catalog", f"""
WITH e AS (SELECT event_id, user_id, {K_SQL} AS k, value, event_type FROM events),
m AS (SELECT event_id, event_type <> 'signup' AS has_video, CASE WHEN event_type <> 'signup' AND value > 1 THEN value ELSE value / 2 END AS dur, CASE WHEN event_type = 'signup' THEN 0 WHEN k = 0 THEN k + 24.0 ELSE k * 1000 / 1001 END AS fps,
  CASE WHEN event_type <> 'signup' THEN user_id * 10 END AS w, CASE WHEN event_type <> 'signup' THEN k * 10 END AS h, CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'view' THEN 270 WHEN event_type = 'click' THEN 90 ELSE 0 END AS rot, event_type IN ('click', 'error') AS audio FROM e)
SELECT event_id, round(dur, 4) + 0.0 AS duration_s, {q6("fps")} AS fps, CAST(rot AS INT) AS rotation_degrees, CAST(CASE WHEN rot IN (90, 270) THEN h ELSE w END AS INT) AS display_width, audio AS has_audio,
  {codes_sql(("no_video_stream", "NOT has_video"), ("no_duration", "round(dur, 4) <= 0"), ("no_frame_rate", "fps <= 0"), ("invalid_dimensions", "w <= 0 OR h <= 0"))} AS reasons FROM m""")
def media_catalog(t):
    k = F.get_json_object("props", "$.k").cast("int")
    e = t.events.select("event_id", "user_id", "event_type", "value", k.alias("k"))
    video = F.struct(
        F.lit("video").alias("codec_type"), (col("user_id") * 10).cast("int").alias("width"), (col("k") * 10).alias("height"), F.when(col("value") > 1, F.format_string("%.6f", "value")).alias("duration"),
        F.when(col("k") == 0, "0/0").otherwise(F.concat((col("k") * 1000).cast("string"), F.lit("/1001"))).alias("avg_frame_rate"), F.concat((col("k") + 24).cast("string"), F.lit("/1")).alias("r_frame_rate"),
        F.when(col("event_type") == "view", F.create_map(F.lit("rotate"), F.lit("-90"))).alias("tags"), F.when(col("event_type") == "click", F.array(F.struct(F.lit(90.0).alias("rotation")))).alias("side_data_list"))
    sound = F.struct(F.lit("audio").alias("codec_type"))
    streams = F.when(col("event_type") == "signup", F.array(F.to_json(F.struct(F.lit("data").alias("codec_type"))))).when(col("event_type").isin("click", "error"), F.array(F.to_json(sound), F.to_json(video))).otherwise(F.array(F.to_json(video)))
    probe = F.concat(F.lit('{"streams": ['), F.array_join(streams, ", "), F.lit('], "format": {"duration": "'), F.format_string("%.6f", col("value") / 2), F.lit('"}}'))
    d = rd.media_catalog(e.select("event_id", probe.alias("probe")), "event_id", "probe")
    return d.select("event_id", (F.round("duration_s", 4) + 0.0).alias("duration_s"), r6("fps").alias("fps"), "rotation_degrees", "display_width", "has_audio", joined("reasons").alias("reasons"))


@query("explode_items", """
WITH f AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations)
SELECT conv_id, position, CAST(turn AS INT) AS candidate_index, role AS path, CAST(n AS DOUBLE) AS chars FROM f""")
def explode_items(t):
    frame = F.struct(col("turn").cast("int").alias("candidate_index"), col("role").alias("path"), F.create_map(F.lit("chars"), F.length("text").cast("double")).alias("metrics"))
    one = t.conversations.select("conv_id", "turn", F.to_json(frame).alias("j"))
    text = one.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "j"))), lambda s: s["j"]).alias("js"))
    text = text.select("conv_id", F.concat(F.lit('{"schema_version": "1", "frames": ['), F.array_join("js", ", "), F.lit("]}")).alias("doc"))
    d = rd.parse_analysis(text, "conv_id", "doc")
    return d.select("conv_id", big("position").alias("position"), "frame.candidate_index", "frame.path", F.col("frame.metrics")["chars"].alias("chars"))


@query("mask_sequence", f"""
WITH m AS (SELECT doc_id, source || '/doc_' || doc_id || '.png' AS path, n_chars / 1000 - 0.05 AS c, lang = 'de' AS refused FROM documents WHERE lang IS NOT NULL AND n_chars / 1000 - 0.05 > 0)
SELECT m.doc_id, path, {q6("c")} AS confidence, refused, l.quality FROM m LEFT JOIN labels l ON l.doc_id = m.doc_id""")
def mask_sequence(t):
    d = t.documents
    m = d.select("doc_id", F.when(col("lang").isNotNull(), F.concat("source", F.lit("/doc_"), col("doc_id").cast("string"), F.lit(".png"))).alias("path"), (col("n_chars") / 1000 - 0.05).alias("confidence"), "lang")
    a = t.labels.select(F.concat(F.lit("frames/doc_"), col("doc_id").cast("string"), F.lit(".jpg")).alias("frame_path"), "quality")
    out = rd.mask_sequence(m, a, "path", "confidence", col("lang") == "de", "frame_path", ["quality"])
    return out.select("doc_id", "path", r6("confidence").alias("confidence"), "refused", "quality")


@query("mesh_text", f"""
WITH l AS (SELECT l_orderkey AS m, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_discount) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
t AS (SELECT l.m, k, n, way FROM (SELECT DISTINCT m, n FROM l) l, (SELECT unnest(range(1, (SELECT max(n) FROM l))) AS k) g, (VALUES (0), (1)) w(way) WHERE k <= n - 2),
v AS (SELECT t.m AS mesh, way, CAST(k - 1 AS INT) AS part, a.x + b.x + c.x AS s, CAST(0 AS BIGINT) AS v0, CAST(k AS BIGINT) AS v1, CAST(k + 1 AS BIGINT) AS v2 FROM t JOIN l a ON a.m = t.m AND a.i = 1 JOIN l b ON b.m = t.m AND b.i = k + 1 JOIN l c ON c.m = t.m AND c.i = k + 2)
SELECT mesh, way AS relative, part, v0, v1, v2, {q6("s")} AS x_sum FROM v""")
def mesh_text(t):
    """Orders as meshes: a vertex line per order line, one polygon with plain ids and one with relative ids."""
    v = t.lineitem.select("l_orderkey", F.struct("l_quantity", "l_extendedprice", "l_discount").alias("p"))
    m = v.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    lines = F.array_join(F.transform("ps", lambda p: F.concat_ws(" ", F.lit("v"), p["l_quantity"].cast("string"), p["l_extendedprice"].cast("string"), p["l_discount"].cast("string"))), "\n")
    n = F.size("ps")
    plain = F.concat(F.lit("f "), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(i.cast("string"), F.lit("/1/1"))), " "))
    back = F.concat(F.lit("f "), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: (i - n - 1).cast("string")), " "))
    texts = m.select(col("l_orderkey").alias("mesh"), F.concat_ws("\n", F.lit("# mesh"), lines, plain, back).alias("text"), n.alias("n"))
    vertices, faces = rd.parse_mesh_text(texts, ["mesh", "n"], "text")
    f = faces.withColumn("relative", (col("line") == col("n") + 2).cast("int"))
    for c in ("v0", "v1", "v2"):
        f = f.join(vertices.select("mesh", col("vid").alias(c), col("x").alias(f"x_{c}")), ["mesh", c])
    return f.select("mesh", "relative", "part", "v0", "v1", "v2", r6(col("x_v0") + col("x_v1") + col("x_v2")).alias("x_sum"))


def text_files(rows, *parts: str) -> str:
    """Write rows of one text column (and folders ``parts``) below the shared folder, and return where."""
    path = f"{checkpoint_folder(rows.sparkSession).rstrip('/')}/text-{uuid.uuid4().hex}"
    rows.write.partitionBy(*parts).text(path)
    return path


@query("mesh_files", f"""
WITH l AS (SELECT l_orderkey AS m, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT m AS l_orderkey, max(n) - 2 AS triangles, {q6("sum(CASE WHEN i = 1 THEN (n - 2) * x WHEN i = 2 OR i = n THEN x ELSE 2 * x END)")} AS x_sum FROM l WHERE n >= 3 GROUP BY 1""")
def mesh_files(t):
    """Orders as vertices and a polygon with relative ids, many in a file; files are read by blocks. A task that gathers
    orders writes them as they come."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_quantity", "l_extendedprice"))).alias("ps"))
    lines = F.array_join(F.transform("ps", lambda p: F.concat_ws(" ", F.lit("v"), p["l_quantity"].cast("string"), col("l_orderkey").cast("string"), F.lit("0"))), "\n")
    face = F.concat(F.lit("f "), F.array_join(F.transform(F.sequence(-F.size("ps"), F.lit(-1)), lambda i: F.concat(i.cast("string"), F.lit("//1"))), " "))
    folder = text_files(rows.select(F.concat_ws("\n", lines, face).alias("value")))
    vertices, faces = rd.read_mesh_text(t.spark, folder)
    vertices = vertices.select("mesh", "vid", "x", col("y").cast("long").alias("y"))
    for c in ("v0", "v1", "v2"):  # renamed behind the joins, so that vertices are shuffled once for all three
        faces = faces.withColumnRenamed(c, "vid").join(vertices, ["mesh", "vid"]).withColumnsRenamed({"vid": c, "x": f"x_{c}", "y": f"y_{c}"})
    faces = faces.where("y_v0 = y_v1 AND y_v1 = y_v2")
    return faces.groupBy(col("y_v0").alias("l_orderkey")).agg(F.count("*").alias("triangles"), r6(F.sum(col("x_v0") + col("x_v1") + col("x_v2"))).alias("x_sum"))


@query("read_analysis", """
SELECT conv_id % 8 AS doc, CAST(conv_id AS INTEGER) AS source_frame_index, CAST(turn AS INT) AS candidate_index, role AS path, CAST(length(text) AS DOUBLE) AS chars, '1' AS schema_version,
  row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) - 1 AS position FROM conversations""")
def read_analysis(t):
    """Conversations as eight analysis files whose frames are their turns, read by blocks."""
    c = t.conversations.select((col("conv_id") % 8).alias("doc"), "conv_id", "turn", "role", F.length("text").alias("n"))
    frame = F.format_string('    {\n      "candidate_index": %d,\n      "metrics": {\n        "chars": %d\n      },\n      "path": "%s",\n      "source_frame_index": %d\n    },', "turn", "n", "role", "conv_id")
    body = c.select("doc", F.struct(F.lit(1), "conv_id", "turn").alias("at"), frame.alias("value"))
    edge = lambda k, text: c.select("doc").distinct().select("doc", F.struct(F.lit(k), F.lit(0).cast("long").alias("conv_id"), F.lit(0).cast(c.schema["turn"].dataType).alias("turn")).alias("at"), F.lit(text).alias("value"))
    rows = edge(0, '{\n  "frames": [').unionByName(body).unionByName(edge(2, '    {\n      "candidate_index": -1\n    }\n  ],\n  "keyframes": [],\n  "schema_version": "1",\n  "warnings": []\n}'))
    folder = text_files(rows.repartition(8, "doc").sortWithinPartitions("doc", "at").select("doc", "value"), "doc")
    d = rd.read_analysis(t.spark, f"{folder}/*")
    out = d.where("frame.candidate_index >= 0").select(
        F.regexp_extract("clip", r"doc=(\d+)", 1).cast("long").alias("doc"), col("frame.source_frame_index").cast("int").alias("source_frame_index"), "frame.candidate_index", "frame.path", F.col("frame.metrics")["chars"].alias("chars"), "schema_version", big("position").alias("position"))
    return out


@query("fan_triples", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), w AS (SELECT doc_id, unnest(ls) AS s FROM l),
n AS (SELECT doc_id, list_transform(list_filter(string_split(s, ' '), lambda x: x <> ''), lambda x: length(x)) AS a FROM w)
SELECT doc_id, CAST(coalesce(sum(greatest(len(a) - 2, 0)), 0) AS BIGINT) AS triangles, CAST(coalesce(sum(CASE WHEN len(a) >= 3 THEN (len(a) - 2) * a[1] + list_sum(a[2:len(a) - 1]) + list_sum(a[3:len(a)]) END), 0) AS BIGINT) AS corner_sum FROM n GROUP BY 1""")
def fan_triples(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    ids = F.transform(F.filter(F.split("s", " "), lambda x: x != ""), lambda x: F.length(x))
    tri = rd.fan(lines.select("doc_id", ids.alias("ids")), "ids").groupBy("doc_id").agg(F.count("*").alias("triangles"), F.sum(col("v0") + col("v1") + col("v2")).alias("corner_sum"))
    return t.documents.select("doc_id").join(tri, "doc_id", "left").select("doc_id", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.coalesce("corner_sum", F.lit(0)).alias("corner_sum"))


class LengthPredictor:
    """Stand-in predictor: the norm and the largest value of a vector."""

    name = "lengths"

    def is_available(self) -> bool:
        return True

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        v = batch["embedding"]
        m = np.stack(v.to_numpy()).astype("float64") if len(v) else np.zeros((0, 1))
        return pd.DataFrame({"vec_id": batch["vec_id"], "norm": np.sqrt((m * m).sum(axis=1)), "top": m.max(axis=1)})


@query("predict", f"SELECT vec_id, {q6('sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))')} AS norm, {q6('list_max(embedding)')} AS top FROM embeddings")
def predict(t):
    d = pr.predict(t.embeddings, LengthPredictor(), ["vec_id"], ["embedding"], "norm double, top double")
    return d.select("vec_id", r6("norm").alias("norm"), r6("top").alias("top"))


def dense(t):
    """Embeddings as 8x8 predictions of ten backends, of which one mixes representations."""
    return t.embeddings.select("vec_id", col("label").alias("backend"), F.lit(8).alias("h"), F.when(col("embedding")[0] > 0.3, 9).otherwise(8).alias("w"), col("embedding").alias("values"),
                               F.when((col("label") == 3) & (col("embedding")[1] > 0), "metric").when(col("label") == 4, "depth").otherwise("relative_inverse").alias("representation"))


@query("contract", f"""
WITH d AS (SELECT vec_id, label, CASE WHEN embedding[1] > 0.3 THEN 9 ELSE 8 END AS w, list_min(embedding) AS mn, CASE WHEN label = 3 AND embedding[2] > 0 THEN 'metric' WHEN label = 4 THEN 'depth' ELSE 'relative_inverse' END AS rep FROM embeddings),
k AS (SELECT label, count(DISTINCT rep) AS n FROM d GROUP BY 1)
SELECT vec_id, {codes_sql(("empty_prediction", "false"), ("shape_mismatch", "w <> 8"), ("not_finite", "false"), ("not_positive", "rep = 'metric' AND mn <= 0"), ("unknown_representation", "rep = 'depth'"), ("mixed_representation", "n > 1"))} AS reasons FROM d JOIN k USING (label)""")
def contract(t):
    return pr.check_predictions(dense(t)).select("vec_id", joined("reasons").alias("reasons"))


@query("reuse_plan", """
WITH e AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) % 3 = 0 AS changed FROM orders), c AS (SELECT o_custkey, o_orderkey, changed FROM e WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT e.o_custkey, bool_and(c.o_orderkey IS NOT NULL AND NOT c.changed) AS reuse, count(*) FILTER (WHERE c.o_orderkey IS NULL OR c.changed) AS to_compute FROM e LEFT JOIN c ON c.o_orderkey = e.o_orderkey GROUP BY 1""")
def reuse_plan(t):
    e = t.orders.select("o_custkey", "o_orderkey", big(F.round("o_totalprice")).alias("p"))
    expected = e.select("o_custkey", "o_orderkey", F.sha2(col("p").cast("string"), 256).alias("input_sha256"))
    stored = e.join(t.lineitem.select(col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_custkey", "o_orderkey", F.sha2((col("p") + (col("p") % 3 == 0).cast("int")).cast("string"), 256).alias("input_sha256"))
    return pr.reuse_plan(expected, stored, ["o_custkey"], ["o_orderkey"], ["input_sha256"]).select("o_custkey", "reuse", "to_compute")


@query("agg_udf", f"SELECT l_suppkey, {q6('sum(l_quantity * l_tax) / sum(l_quantity)')} AS weighted_mean, {q6('max(l_extendedprice) - min(l_extendedprice)')} AS spread FROM lineitem GROUP BY 1")
def agg_udf(t):
    def partial(g):
        return g.agg(w=("l_quantity", "sum"), s=("taxed", "sum"), lo=("l_extendedprice", "min"), hi=("l_extendedprice", "max"))

    def merge(g):
        return g.agg({"w": "sum", "s": "sum", "lo": "min", "hi": "max"})

    def finish(d):
        return pd.DataFrame({"weighted_mean": d["s"] / d["w"], "spread": d["hi"] - d["lo"]})

    rows = t.lineitem.select("l_suppkey", "l_quantity", (col("l_quantity") * col("l_tax")).alias("taxed"), "l_extendedprice")
    d = pr.merge_aggregate(rows, ["l_suppkey"], partial, merge, finish, "w double, s double, lo double, hi double", "weighted_mean double, spread double")
    return d.select("l_suppkey", r6("weighted_mean").alias("weighted_mean"), r6("spread").alias("spread"))


@query("grid", f"""
WITH g AS (SELECT p_partkey, p_size / 50 AS r, -1 + ix AS x, -1 + iy AS y, -1 + iz AS z FROM part, range(3) a(ix), range(3) b(iy), range(3) c(iz))
SELECT p_partkey, count(*) AS cells, count(*) FILTER (WHERE x*x + y*y + z*z <= 4 * r * r) AS inside, {q6("sum(x + y * 2 + z * 3)")} AS checksum FROM g GROUP BY 1""")
def grid(t):
    g = voxel_grid(t.part.select("p_partkey", (col("p_size") / 50).alias("r")), 3)
    inside = col("x") ** 2 + col("y") ** 2 + col("z") ** 2 <= 4 * col("r") * col("r")
    return g.groupBy("p_partkey").agg(F.count("*").alias("cells"), F.count(F.when(inside, 1)).alias("inside"), r6(F.sum(col("x") + col("y") * 2 + col("z") * 3)).alias("checksum"))


def sparse_models(t):
    """Suppliers as clips: a part is a point seen in the lines that order it."""
    track = F.collect_list(F.struct(big("l_orderkey").alias("view"), (col("l_quantity") + col("l_linenumber") / 10).alias("u"), col("l_tax").alias("v")))
    xyz = F.array(F.min("l_quantity"), F.max("l_discount"), F.min("l_extendedprice"))
    p = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(track.alias("track"), xyz.alias("xyz"), F.max("l_tax").alias("error"))
    return p.groupBy("l_suppkey").agg(F.collect_list(F.struct(col("l_partkey").alias("id"), "xyz", "track", "error")).alias("points"))


@query("sparse_points", """
SELECT l_suppkey, l_partkey AS point_id, min(l_quantity) AS x, max(l_discount) AS y, min(l_extendedprice) AS z, count(*) AS track_length, max(l_tax) AS error FROM lineitem GROUP BY 1, 2""")
def sparse_points(t):
    return rd.sparse_points(sparse_models(t), "l_suppkey").withColumn("track_length", big("track_length"))


@query("sparse_observations", f"SELECT l_suppkey, l_partkey AS point_id, CAST(l_orderkey AS BIGINT) AS view, {q6('l_quantity + l_linenumber / 10')} AS u, l_tax AS v FROM lineitem")
def sparse_observations(t):
    return rd.sparse_observations(sparse_models(t), "l_suppkey").withColumn("u", r6("u"))


@query("read_predictions", f"""
WITH d AS (SELECT vec_id, label, CASE WHEN embedding[1] > 0.3 THEN 9 ELSE 8 END AS w, list_min(embedding) AS mn, CASE WHEN label = 3 AND embedding[2] > 0 THEN 'metric' WHEN label = 4 THEN 'depth' ELSE 'relative_inverse' END AS rep FROM embeddings),
k AS (SELECT label, count(DISTINCT rep) AS n FROM d GROUP BY 1)
SELECT vec_id, {codes_sql(("empty_prediction", "false"), ("shape_mismatch", "w <> 8"), ("not_finite", "false"), ("not_positive", "rep = 'metric' AND mn <= 0"), ("unknown_representation", "rep = 'depth'"), ("mixed_representation", "n > 1"))} AS reasons, vec_id % 7 <> 0 AS hash_matches FROM d JOIN k USING (label)""")
def read_predictions(t):
    """Predictions written to the shared folder, some with another content hash, and read back."""
    d = dense(t).withColumn("output_sha256", F.when(col("vec_id") % 7 == 0, "0").otherwise(array_hash(col("values"), "float32", F.array("h", "w"))))
    path = f"{checkpoint_folder(t.spark)}/predictions-{uuid.uuid4().hex}"
    d.write.parquet(path)
    return rd.read_predictions(t.spark, path).select("vec_id", joined("reasons").alias("reasons"), "hash_matches")


@query("publish", f"""
SELECT l_suppkey, count(*) AS "rows", {q6("max(l_extendedprice)")} AS highest, {q6("max(l_discount) FILTER (WHERE l_returnflag = 'R')")} AS returned FROM lineitem GROUP BY 1""")
def publish(t):
    """A report with a map of numbers, published once as JSON and read back."""
    d = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("rows"), F.create_map(F.lit("highest"), F.max("l_extendedprice"), F.lit("returned"), F.max(F.when(col("l_returnflag") == "R", col("l_discount")))).alias("metrics"))
    path = f"{checkpoint_folder(t.spark)}/report-{uuid.uuid4().hex}"
    sinks.publish(d, path)
    back = t.spark.read.schema("l_suppkey long, rows long, metrics map<string,double>").json(path)
    return back.select("l_suppkey", "rows", r6(col("metrics")["highest"]).alias("highest"), r6(col("metrics")["returned"]).alias("returned"))


@query("predict_missing", f"""
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1.0 ELSE {q6('sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))')} END AS norm, CASE WHEN vec_id % 3 = 0 THEN -2.0 ELSE {q6('list_max(embedding)')} END AS top FROM embeddings""")
def predict_missing(t):
    """A third is stored with the inputs it was made from, a third with others, a third not at all."""
    e = t.embeddings.withColumn("version", big("label"))
    stored = e.where("vec_id % 3 < 2").select("vec_id", (col("version") + col("vec_id") % 3).alias("version"), F.lit(-1.0).alias("norm"), F.lit(-2.0).alias("top"))
    d = pr.predict_missing(e, stored, LengthPredictor(), ["vec_id"], ["embedding"], ["version"], "norm double, top double")
    return d.select("vec_id", r6("norm").alias("norm"), r6("top").alias("top"))


@query("table_functions", """
SELECT p_partkey, 'box' AS kind, count(*) AS cells, CAST(sum(y * 100 + x) AS BIGINT) AS checksum FROM (SELECT p_partkey, p_size % 4 + a.i AS y, b.i AS x FROM part, range(3) a(i), range(3) b(i) WHERE b.i <= p_partkey % 3) GROUP BY 1
UNION ALL SELECT p_partkey, 'fan', count(*), CAST(sum(1 + 10 * (k + 1) + 100 * (k + 2)) AS BIGINT) FROM (SELECT p_partkey, i.i AS k FROM part, range(1, 6) i(i) WHERE i.i <= p_size % 6 - 1) GROUP BY 1
UNION ALL SELECT p_partkey, 'grid', count(*), CAST(sum(z * 9 + y * 3 + x) AS BIGINT) FROM (SELECT p_partkey, a.i AS z, b.i AS y, c.i AS x FROM part, range(3) a(i), range(3) b(i), range(3) c(i) WHERE greatest(a.i, b.i, c.i) < 2 + p_size % 2) GROUP BY 1""")
def table_functions(t):
    """Generators called from SQL with LATERAL."""
    tables.register(t.spark)
    return t.spark.sql("""
SELECT p_partkey, 'box' AS kind, count(*) AS cells, sum(y * 100 + x) AS checksum FROM {part}, LATERAL box_pixels(CAST(p_size % 4 AS INT), CAST(p_size % 4 + 2 AS INT), 0, CAST(p_partkey % 3 AS INT)) GROUP BY p_partkey
UNION ALL SELECT p_partkey, 'fan', count(*), sum(v0 + 10 * v1 + 100 * v2) FROM {part}, LATERAL fan_triangles(sequence(1L, CAST(p_size % 6 + 1 AS BIGINT))) GROUP BY p_partkey
UNION ALL SELECT p_partkey, 'grid', count(*), sum(iz * 9 + iy * 3 + ix) FROM {part}, LATERAL grid_cells(CAST(2 + p_size % 2 AS INT), -1.0D, 1.0D) GROUP BY p_partkey""", part=t.part)
