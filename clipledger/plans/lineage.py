"""Queries for integrity and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.operators import lineage as ln
from clipledger.plans.registry import big, codes_sql, joined, q6, query, r6

col = F.col


@query("audit_sets", f"""
WITH e AS (SELECT o_orderkey, o_orderstatus AS st, CAST(o_custkey % 7 AS INT) AS n FROM orders WHERE o_orderstatus <> 'P'), a AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS st, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(e.o_orderkey, a.o_orderkey) AS o_orderkey, {codes_sql(("missing", "a.o_orderkey IS NULL"), ("unexpected", "e.o_orderkey IS NULL"), ("st_differs", "e.o_orderkey IS NOT NULL AND a.o_orderkey IS NOT NULL AND e.st IS DISTINCT FROM a.st"), ("n_differs", "e.o_orderkey IS NOT NULL AND a.o_orderkey IS NOT NULL AND e.n IS DISTINCT FROM a.n"))} AS reasons
FROM e FULL JOIN a ON e.o_orderkey = a.o_orderkey""")
def audit_sets(t):
    e = t.orders.where("o_orderstatus != 'P'").select("o_orderkey", col("o_orderstatus").alias("st"), (col("o_custkey") % 7).cast("int").alias("n"))
    a = t.lineitem.groupBy(col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("st"), F.count("*").cast("int").alias("n"))
    return ln.audit_sets(e, a, ["o_orderkey"], ["st", "n"]).select("o_orderkey", joined("reasons").alias("reasons"))


@query("checksum_audit", f"""
WITH e AS (SELECT doc_id, source || '/' || doc_id AS path, n_chars AS sz, sha256(text) AS h FROM documents),
f AS (SELECT source || '/' || doc_id AS path, length(text) AS sz, CASE WHEN lang = 'fr' THEN sha256(text || ' ') ELSE sha256(text) END AS h, n_chars % 2 = 0 AS bin FROM documents JOIN labels USING (doc_id))
SELECT doc_id, {codes_sql(("outside_root", "NOT starts_with(e.path, 'src0/')"), ("missing_file", "f.path IS NULL"), ("size_mismatch", "f.path IS NOT NULL AND e.sz IS DISTINCT FROM f.sz"), ("hash_mismatch", "f.path IS NOT NULL AND e.h IS DISTINCT FROM f.h"),
  ("not_binary_mask", "f.path IS NOT NULL AND NOT coalesce(bin, false)"), ("dimension_mismatch", "false"))} AS reasons FROM e LEFT JOIN f ON e.path = f.path""")
def checksum_audit(t):
    d = t.documents
    path = F.concat("source", F.lit("/"), col("doc_id").cast("string"))
    e = d.select("doc_id", path.alias("path"), col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    f = d.join(t.labels.select("doc_id"), "doc_id").select(path.alias("path"), big(F.length("text")).alias("size_bytes"), F.sha2(F.when(col("lang") == "fr", F.concat("text", F.lit(" "))).otherwise(col("text")), 256).alias("sha256"),
                                                          F.lit(1).alias("width"), F.lit(1).alias("height"), (col("n_chars") % 2 == 0).alias("binary_mask"))
    return ln.audit_files(e, f, "src0").select("doc_id", joined("reasons").alias("reasons"))


@query("array_hash", """
SELECT vec_id, sha256('int64|8x8|' || array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)), ',')) AS digest FROM embeddings""")
def array_hash(t):
    v = F.transform("embedding", lambda x: big(F.round(x.cast("double") * 1000000)))
    return t.embeddings.select("vec_id", ln.array_hash(v, "int64", F.array(F.lit(8), F.lit(8))).alias("digest"))


@query("resume_plan", """
WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_custkey % 4 AS attempts FROM orders),
a AS (SELECT l_orderkey, bool_and(l_linestatus = 'O' OR l_discount <= 0.08) AS ok, count(*) AS outputs FROM lineitem GROUP BY 1)
SELECT o_orderkey, attempts, coalesce(outputs, 0) AS outputs, CASE WHEN status = 'completed' AND coalesce(outputs, 0) >= 1 AND coalesce(ok, false) THEN 'skip' ELSE 'run' END AS action FROM s LEFT JOIN a ON o_orderkey = l_orderkey""")
def resume_plan(t):
    s = t.orders.select("o_orderkey", F.lit("stage").alias("stage"), F.when(col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), (col("o_custkey") % 4).alias("attempts"))
    found = F.when((col("l_linestatus") == "O") | (col("l_discount") <= 0.08), col("l_partkey")).otherwise(col("l_partkey") + 1)
    a = t.lineitem.select(col("l_orderkey").alias("o_orderkey"), F.lit("stage").alias("produced_by"), F.lit(True).alias("in_root"), col("l_suppkey").alias("size_bytes"), col("l_suppkey").alias("found_size"), F.sha2(col("l_partkey").cast("string"), 256).alias("sha256"), F.sha2(found.cast("string"), 256).alias("found_sha256"))
    return ln.resume_plan(s, a, ["o_orderkey"]).select("o_orderkey", "attempts", "outputs", "action")


@query("register_check", f"""
WITH p AS (SELECT p_partkey, p_brand AS g, CASE WHEN p_size = 1 THEN ' ' ELSE p_name || p_size END AS key, p_type || '/' || p_name AS path FROM part), n AS (SELECT g, key, count(*) AS n FROM p GROUP BY 1, 2)
SELECT p_partkey, {codes_sql(("empty_key", "length(trim(key)) = 0"), ("duplicate_key", "n > 1"), ("outside_root", "NOT starts_with(path, 'ECONOMY/')"))} AS reasons FROM p JOIN n USING (g, key)""")
def register_check(t):
    p = t.part.select("p_partkey", col("p_brand").alias("g"), F.when(col("p_size") == 1, " ").otherwise(F.concat("p_name", col("p_size").cast("string"))).alias("key"), F.concat("p_type", F.lit("/"), "p_name").alias("path"))
    return ln.register_check(p, ["g"], "key", "path", "ECONOMY").select("p_partkey", joined("reasons").alias("reasons"))


@query("media_audit", """
WITH c AS (SELECT o_orderkey, CAST(o_custkey % 6 AS BIGINT) AS reported FROM orders), f AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS i FROM lineitem),
g AS (SELECT l_orderkey, i, (SELECT min(l_discount) FROM lineitem l WHERE l.l_orderkey = f.l_orderkey AND l.l_linenumber - 1 = f.i) < 0.09 AS ok FROM f),
s AS (SELECT o_orderkey, count(*) FILTER (WHERE ok) AS d, coalesce(bool_or(i = 0 AND ok), false) AS f, coalesce(bool_or(i = reported // 2 AND ok), false) AS m, coalesce(bool_or(i = reported - 1 AND ok), false) AS l FROM c JOIN g ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c.o_orderkey, reported, coalesce(d, 0) AS decodable, coalesce(f, false) AS first_ok, coalesce(l, false) AS last_ok, CASE WHEN coalesce(d, 0) = reported AND f AND m AND l THEN 'pass' ELSE 'fail' END AS verdict FROM c LEFT JOIN s USING (o_orderkey)""")
def media_audit(t):
    c = t.orders.select("o_orderkey", (col("o_custkey") % 6).alias("reported"))
    f = t.lineitem.groupBy(col("l_orderkey").alias("o_orderkey"), big(col("l_linenumber") - 1).alias("i")).agg(F.min("l_discount").alias("d"))
    return ln.media_audit(c, f, ["o_orderkey"], "i", col("d") < 0.09).select("o_orderkey", "reported", "decodable", "first_ok", "last_ok", "verdict")


@query("job_summary", """
WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS st, o_orderdate FROM orders), n AS (SELECT o_custkey, st, count(*) AS n, max(o_orderdate) AS u FROM s GROUP BY 1, 2)
SELECT o_custkey, string_agg(st || '=' || n, ',' ORDER BY st) AS counts, CAST(sum(n) AS BIGINT) AS stages, strftime(max(u), '%Y-%m-%d') AS updated, CASE WHEN bool_or(st = 'failed') THEN 'failed' WHEN bool_and(st = 'completed') THEN 'completed' ELSE 'pending' END AS state FROM n GROUP BY 1""")
def job_summary(t):
    s = t.orders.select("o_custkey", F.when(col("o_orderstatus") == "F", "completed").when(col("o_orderstatus") == "P", "failed").otherwise("running").alias("st"), "o_orderdate")
    d = ln.job_summary(s, ["o_custkey"], "st", "o_orderdate")
    counts = joined(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return d.select("o_custkey", counts.alias("counts"), "stages", F.date_format("updated", "yyyy-MM-dd").alias("updated"), "state")


@query("unchanged", """
WITH a AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), b AS (SELECT n_nationkey, CASE WHEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) > 4 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation)
SELECT bool_and(a.n_name = b.n_name) AS unchanged, count(*) FILTER (WHERE a.n_name <> b.n_name) AS differences FROM a JOIN b USING (n_nationkey)""")
def unchanged(t):
    busy = t.supplier.groupBy(col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    after = t.nation.join(busy, "n_nationkey", "left").select("n_nationkey", F.when(col("n") > 4, F.concat(F.upper("n_name"), F.lit("!"))).otherwise(col("n_name")).alias("n_name"), "n_regionkey")
    return ln.unchanged(t.nation, after, ["n_nationkey"], ["n_name", "n_regionkey"])


@query("freeze", f"""
WITH RECURSIVE h AS (SELECT o_orderpriority AS g, sha256(o_orderkey || '|' || o_orderstatus || ':' || o_custkey) AS h, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
b AS (SELECT 0 AS turn, g, i, h, n, n AS "rows" FROM h
  UNION ALL SELECT turn + 1, g, i // {ln.DIGEST_BLOCK}, sha256(string_agg(h, chr(10) ORDER BY i)), count(*) OVER (PARTITION BY g), "rows" FROM b WHERE turn = 0 OR n > 1 GROUP BY turn, g, i // {ln.DIGEST_BLOCK}, "rows")
SELECT g AS o_orderpriority, CAST("rows" AS BIGINT) AS "rows", h AS digest FROM b WHERE turn > 0 AND n = 1""")
def freeze(t):
    return ln.freeze(t.orders, ["o_orderpriority"], "o_orderkey", F.concat("o_orderstatus", F.lit(":"), col("o_custkey").cast("string")))


@query("promote", """
WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
a AS (SELECT o_custkey, l_returnflag, l_linestatus || ':' || l_partkey || ':' || l_linenumber AS content FROM lineitem JOIN c ON l_orderkey = o_orderkey WHERE rn = 1 AND l_returnflag IN ('A', 'R'))
SELECT DISTINCT o_custkey, CASE l_returnflag WHEN 'A' THEN 'asset.glb' ELSE 'report.json' END AS stable_name, strlen(content) AS size_bytes, sha256(content) AS sha256 FROM a""")
def promote(t):
    win = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -col("o_orderkey"))).alias("selected"))
    a = t.lineitem.join(t.orders.select(col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", col("l_orderkey").alias("candidate"), "l_returnflag", F.concat_ws(":", "l_linestatus", col("l_partkey").cast("string"), col("l_linenumber").cast("string")).alias("content"))
    return ln.promote(a, win, ["o_custkey"], "candidate", {"A": "asset.glb", "R": "report.json"}, "l_returnflag", col("content")).distinct()
