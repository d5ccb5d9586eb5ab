"""Queries for splits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.functions import text
from clipledger.functions.text import id_token
from clipledger.functions.times import micros
from clipledger.operators import splits as sp
from clipledger.plans.aggregates import LINE_ORDER
from clipledger.plans.registry import big, joined, q6, query, r6

col = F.col


@query("hash_split", f"""
WITH h AS (SELECT DISTINCT 'int:' || o_orderkey AS token, sha256('{sp.SEED}' || chr(0) || 'int:' || o_orderkey) AS digest FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY digest, token) AS rank, count(*) OVER () AS n FROM h)
SELECT token, rank, CASE WHEN rank <= least(greatest(round_even(n * 0.67, 0), 1), n - 1) THEN 'calibration' ELSE 'evaluation' END AS role FROM r""")
def hash_split(t):
    o = t.orders
    return sp.hash_split(o, [], id_token(col("o_orderkey"), o.schema["o_orderkey"].dataType)).select("token", "rank", "role")


@query("dedup_obs", f"""
WITH g AS (SELECT l_suppkey, l_partkey, l_discount * 60 AS e, l_linenumber AS t, l_quantity * 30 AS u, l_tax * 9000 AS v, l_extendedprice / 1000 AS z, l_orderkey FROM lineitem
  WHERE l_extendedprice / 1000 > 1e-9 AND l_linenumber >= 2 AND l_discount * 60 <= 4 AND l_quantity * 30 >= 0 AND l_quantity * 30 < 1279 AND l_tax * 9000 >= 0 AND l_tax * 9000 < 719 AND l_returnflag <> 'N'),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY e, -t, u, v, z, l_orderkey) AS rn FROM g)
SELECT l_suppkey, l_partkey, l_orderkey, CAST(t AS BIGINT) AS track_length, {q6("e")} AS error, {q6("least(t, 10) / 10 / (1 + (e / 2) * (e / 2))")} AS weight FROM r WHERE rn = 1""")
def dedup_obs(t):
    d = sp.dedup_observations(
        t.lineitem, ["l_suppkey"], "l_partkey", ["l_orderkey"], z=col("l_extendedprice") / 1000, track=col("l_linenumber"), error=col("l_discount") * 60,
        u=col("l_quantity") * 30, v=col("l_tax") * 9000, width=F.lit(1280), height=F.lit(720), on_mask=col("l_returnflag") != "N")
    return d.select("l_suppkey", "l_partkey", "l_orderkey", big("track_length").alias("track_length"), r6("error").alias("error"), r6("weight").alias("weight"))


_RN = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n"


@query("even_sample", f"""
WITH r AS (SELECT o_custkey, o_orderkey, {_RN} FROM orders),
g AS (SELECT DISTINCT o_custkey, CAST(round_even(j * ((n - 1) / 3.0::DOUBLE), 0) AS BIGINT) AS i FROM (SELECT DISTINCT o_custkey, n FROM r WHERE n > 4), (SELECT unnest(range(4)) AS j))
SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 UNION ALL SELECT o_custkey, o_orderkey FROM r JOIN g USING (o_custkey, i)""")
def even_sample(t):
    return sp.even_sample(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("holdout", f"""
WITH r AS (SELECT o_custkey, o_orderkey, {_RN} FROM orders),
c AS (SELECT DISTINCT o_custkey, n, least(greatest(3, n // 6), greatest(0, n - 8)) AS c FROM r),
g AS (SELECT DISTINCT o_custkey, CAST(round_even(j * ((n - 1) / (c + 1)::DOUBLE), 0) AS BIGINT) AS i FROM (SELECT *, unnest(range(1, c + 1)) AS j FROM c WHERE c > 0))
SELECT r.o_custkey, o_orderkey, CASE WHEN g.i IS NULL THEN 'reconstruction' ELSE 'holdout' END AS evaluation_role, g.i IS NULL AS used_for_geometry FROM r LEFT JOIN g ON g.o_custkey = r.o_custkey AND g.i = r.i""")
def holdout(t):
    return sp.assign_holdout(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "evaluation_role", "used_for_geometry")


@query("union_tagged", """
SELECT 'customer' AS provenance, c_nationkey AS nation, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_name FROM supplier""")
def union_tagged(t):
    return sp.union_tagged({
        "supplier": t.supplier.select(col("s_nationkey").alias("nation"), col("s_name").alias("name")),
        "customer": t.customer.select(col("c_nationkey").alias("nation"), col("c_name").alias("name")),
    }).select("provenance", "nation", "name")


@query("common_names", """
SELECT o_custkey AS key FROM orders INTERSECT SELECT l_suppkey FROM lineitem INTERSECT SELECT user_id FROM events""")
def common_names(t):
    return sp.common_names([t.orders.select(col("o_custkey").alias("key")), t.lineitem.select("l_suppkey"), t.events.select("user_id")])


@query("difference", """
SELECT doc_id AS key FROM documents EXCEPT SELECT doc_id FROM labels""")
def difference(t):
    return sp.difference(t.documents.select(col("doc_id").alias("key")), t.labels.select("doc_id"))


@query("ordered_distinct", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS kinds FROM f GROUP BY 1""")
def ordered_distinct(t):
    d = sp.merge_ordered(t.events, ["user_id"], "event_id", "event_type", "kinds")
    return d.select("user_id", joined("kinds").alias("kinds"))


@query("missing", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM labels)""")
def missing(t):
    return sp.missing(t.customer.select("c_custkey", "c_name"), t.labels.select(col("doc_id").alias("c_custkey")), ["c_custkey"])


@query("scalars", f"""
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS stamp, epoch_us(ts) AS us, {q6("CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 0 THEN 0 ELSE user_id / CAST(json_extract_string(props, '$.k') AS INTEGER) END")} AS ratio,
  {q6("round_even(value / 5, 0)")} AS half_even, {q6("((value - 50) % 7 + 7) % 7")} AS modulo, {q6("sqrt(value * value + user_id * user_id)")} AS hypot, event_type || '_' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS name,
  isfinite(value) AS finite FROM events""")
def scalars(t):
    """Scalar functions: stamps, rational numbers, half-even rounding, positive modulo, padded names."""
    ratio = text.rational(F.concat(col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k")))
    return t.events.select(
        "event_id", text.utc_stamp(col("ts")).alias("stamp"), micros(col("ts")).alias("us"), r6(ratio).alias("ratio"), r6(F.rint(col("value") / 5)).alias("half_even"),
        r6(F.pmod(col("value") - 50, F.lit(7.0))).alias("modulo"), r6(F.hypot("value", "user_id")).alias("hypot"), F.concat("event_type", F.lit("_"), text.padded_name("", col("event_id"), 8)).alias("name"), text.finite(col("value")).alias("finite"))
