"""Streaming queries over the events, run to completion and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clipledger.functions.rules import Rule, apply_gates
from clipledger.functions.times import micros
from clipledger.plans.registry import big, codes_sql, joined, q6, query, r6
from clipledger.plans.windows import FRAMES
from clipledger.session import checkpoint_folder
from clipledger.streaming import streams as st

col = F.col
K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
HOUR = 3_600_000_000


def folders(spark) -> tuple[str, str]:
    """Fresh output and checkpoint folders below the shared checkpoint folder of the session."""
    run = f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/state"


def event_stream(t):
    """The events table as a file stream with an instant column."""
    d = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.path)
    k = F.get_json_object("props", "$.k").cast("int")
    return d.select("event_id", "user_id", "event_type", "value", k.alias("k"), micros(col("ts")).alias("us")).withColumn("at", F.timestamp_micros("us"))


#: A time after all events, to close what is still open at the end of a finished stream.
END = "2200-01-01 00:00:00"


def ending(t):
    """The event stream in a form that can be closed, and where its end is announced."""
    end = f"{folders(t.spark)[0]}-end"
    return st.closable(event_stream(t), end), end


@query("stream_runs", f"""
WITH {FRAMES}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w >= {8 * HOUR} THEN 1 ELSE 0 END AS nw FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY us)), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS "rows", {q6("max(value)")} AS best FROM r GROUP BY user_id, run""")
def stream_runs(t):
    out, state = folders(t.spark)
    source, end = ending(t)
    d = st.run_to_end(st.stream_runs(source, ["user_id"], "at", "8 hours", "1 hour", best=F.max("value")), "at", END, end, source, out, state)
    return d.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "rows", r6("best").alias("best"))


@query("stream_hints", f"""
WITH {FRAMES}, e AS (SELECT user_id, event_type, us, k / 100.0 AS c FROM fr WHERE k / 100.0 >= 0.2), w AS (SELECT *, us // {24 * HOUR} * {24 * HOUR} - s * {12 * HOUR} + CASE WHEN us % {24 * HOUR} >= {12 * HOUR} THEN {12 * HOUR} ELSE 0 END AS b FROM e, (VALUES (0), (1)) v(s))
SELECT user_id, b AS start_us, event_type, count(*) AS "rows", {q6("avg(c)")} AS mean_confidence, {q6("max(c)")} AS best_confidence FROM w GROUP BY 1, 2, 3""")
def stream_hints(t):
    out, state = folders(t.spark)
    source, end = ending(t)
    d = st.stream_hints(source.withColumn("c", F.coalesce(col("k") / 100.0, F.lit(1.0))), ["user_id"], "at", "event_type", "c", "24 hours", "1 hour", "12 hours")
    d = st.run_to_end(d, "at", END, end, source, out, state)
    return d.select("user_id", F.unix_micros("start").alias("start_us"), "event_type", "rows", r6("mean_confidence").alias("mean_confidence"), r6("best_confidence").alias("best_confidence"))


@query("stream_hint_winner", f"""
WITH {FRAMES}, e AS (SELECT user_id, event_type, us, k / 100.0 AS c FROM fr WHERE k / 100.0 >= 0.2), w AS (SELECT *, us // {24 * HOUR} * {24 * HOUR} AS b FROM e),
g AS (SELECT user_id, b, event_type, count(*) AS sf, avg(c) AS m FROM w GROUP BY 1, 2, 3), n AS (SELECT user_id, b, max(sf) AS nf FROM g GROUP BY 1, 2),
s AS (SELECT g.*, sf / nf AS frac, round(m * sqrt(sf / nf), 12) AS score, row_number() OVER (PARTITION BY user_id, b ORDER BY round(m * sqrt(sf / nf), 12) DESC, event_type) AS rn FROM g JOIN n USING (user_id, b)),
d AS (SELECT user_id, b, max(event_type) FILTER (WHERE rn = 1) AS hint, max(score) FILTER (WHERE rn = 1) AS score, max(sf) FILTER (WHERE rn = 1) AS sf, max(frac) FILTER (WHERE rn = 1) AS frac, round(max(score) FILTER (WHERE rn = 1) - coalesce(max(score) FILTER (WHERE rn = 2), 0), 12) AS margin FROM s GROUP BY 1, 2)
SELECT user_id, b AS start_us, hint, {q6("score")} AS score, {q6("margin")} AS margin,
  {codes_sql(("no_mapped_evidence", "hint IS NULL"), ("score_too_low", "score < 0.3"), ("too_few_support_frames", "sf < 2"), ("support_fraction_too_low", "frac < 0.15"), ("margin_too_small", "margin < 0.08"))} AS reasons FROM d""")
def stream_hint_winner(t):
    """The hint of each day, decided when the day's window closes; the busiest kind's rows stand for the frames."""
    out, state = folders(t.spark)
    source, end = ending(t)
    d = st.stream_hints(source.withColumn("c", F.coalesce(col("k") / 100.0, F.lit(1.0))), ["user_id"], "at", "event_type", "c", "24 hours", "1 hour")
    build = lambda rows: st.decide_hints(rows.withColumn("frames", col("rows")), ["user_id"], "event_type")
    d = st.run_to_end(d, "at", END, end, source, out, state, build=build)
    return d.select("user_id", F.unix_micros("start").alias("start_us"), "hint", r6("score").alias("score"), r6("margin").alias("margin"), joined("reasons").alias("reasons"))


@query("stream_jobs", """
WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS st FROM events)
SELECT user_id, max_by(st, row(us, st)) AS status, max(us) AS updated_us, count(DISTINCT event_id) AS events, count(DISTINCT event_id) FILTER (WHERE st = 'started') AS attempts FROM s GROUP BY 1""")
def stream_jobs(t):
    out, state = folders(t.spark)
    s = F.when(col("event_type") == "signup", "started").when(col("event_type") == "purchase", "completed").when(col("event_type") == "error", "failed").otherwise("running")
    # every event is delivered twice, as an at-least-once source may do
    d = event_stream(t).withColumn("st", s).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    d = st.latest_per_key(st.run_once(st.stream_jobs(d, "user_id", "event_id", "at", "st", "1 hour"), out, state, "update"), ["user_id"])
    return d.select("user_id", "status", F.unix_micros("updated").alias("updated_us"), "events", "attempts")


_JOB_EVENTS = """e AS (SELECT user_id, CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN 'segmentation' ELSE 'reconstruction' END AS stage, event_id % 5 AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, id) AS i FROM e)"""


@query("stream_job_state", f"""
WITH {_JOB_EVENTS},
st AS (SELECT user_id, stage, max_by(kind, i) AS last_kind, count(*) FILTER (WHERE kind = 'started') AS attempts, coalesce(max(i) FILTER (WHERE kind = 'started'), 0) AS begun FROM o GROUP BY 1, 2),
ar AS (SELECT o.user_id, o.stage || '/' || n AS key, max_by(id, i) AS digest FROM o JOIN st USING (user_id, stage) WHERE kind = 'completed' AND i > begun GROUP BY 1, 2),
al AS (SELECT user_id, string_agg(key || '=' || digest, ',' ORDER BY key || '=' || digest) AS artifacts FROM ar GROUP BY 1),
jb AS (SELECT user_id, max_by(kind, i) AS last_kind, max_by(stage, i) AS last_stage, max(us) AS updated_us, count(*) AS events FROM o GROUP BY 1),
dn AS (SELECT user_id, count(*) FILTER (WHERE last_kind = 'completed') = 2 AS done, coalesce(max(attempts) FILTER (WHERE stage = 'segmentation'), 0) AS a, coalesce(max(attempts) FILTER (WHERE stage = 'reconstruction'), 0) AS b FROM st GROUP BY 1)
SELECT user_id, CASE WHEN last_kind = 'failed' THEN 'failed' WHEN last_kind = 'completed' AND done THEN 'completed' ELSE 'running' END AS status, CASE WHEN last_kind = 'completed' THEN NULL ELSE last_stage END AS active_stage,
  updated_us, events, a || '/' || b AS attempts, coalesce(artifacts, '') AS artifacts FROM jb JOIN dn USING (user_id) LEFT JOIN al USING (user_id)""")
def stream_job_state(t):
    """Users as jobs of two stages whose events carry artifacts; every event is delivered twice."""
    out, state = folders(t.spark)
    kind = F.when(col("event_type") == "signup", "started").when(col("event_type") == "purchase", "completed").when(col("event_type") == "error", "failed")
    stage = F.when(col("event_id") % 2 == 0, "segmentation").otherwise("reconstruction")
    made = F.array(F.struct(F.concat_ws("/", "stage", (col("event_id") % 5).cast("string")).alias("key"), col("event_id").cast("string").alias("digest")))
    d = event_stream(t).withColumns({"kind": kind, "stage": stage}).where("kind IS NOT NULL").withColumn("made", F.when(col("kind") == "completed", made))
    d = d.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    with st.rocksdb(t.spark):
        d = st.stream_job_state(d, "user_id", "event_id", "at", "kind", "stage", "made", ["segmentation", "reconstruction"], "1 hour", 3_600_000)
        d = st.latest_per_key(st.run_once(d, out, state, "update"), ["job"])
    return d.select(col("job").alias("user_id"), "status", "active_stage", "updated_us", "events", F.concat_ws("/", col("attempts").cast("array<string>")).alias("attempts"), joined("artifacts").alias("artifacts"))


@query("stream_cadence", f"""
WITH RECURSIVE {FRAMES}, f AS (SELECT user_id, event_id, us / 1e6 - 1704067200 AS d, row_number() OVER (PARTITION BY user_id ORDER BY us / 1e6 - 1704067200, event_id) AS i FROM fr),
x AS (SELECT user_id, event_id, i, CASE WHEN d >= (i - 1) / {1 / 40000!r} * 0.5 THEN d ELSE (i - 1) / {1 / 40000!r} END AS t FROM f),
s AS (SELECT user_id, 0 AS i, 0::BIGINT AS nxt, 0 AS n, NULL::BIGINT AS event_id FROM f GROUP BY 1
  UNION ALL SELECT z.user_id, CAST(z.xi AS INTEGER), CASE WHEN hit THEN greatest(z.nxt + 1, CAST(floor(z.t / 43200.0) AS BIGINT) + 1) ELSE z.nxt END, z.n + hit::INT, CASE WHEN hit THEN z.ev END
  FROM (SELECT s.user_id, x.i AS xi, s.nxt, s.n, x.t, x.event_id AS ev, x.t + 20000.0 >= s.nxt * 43200.0 AND s.n < 50 AS hit FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1) z)
SELECT user_id, event_id AS frame, n - 1 AS candidate_index FROM s WHERE event_id IS NOT NULL""")
def stream_cadence(t):
    out, state = folders(t.spark)
    d = event_stream(t).withColumn("device", col("us") / 1e6 - 1704067200)
    d = st.run_once(st.stream_cadence(d, "user_id", "at", "event_id", "device", 1 / 43200.0, 1 / 40000, 50, "1 hour"), out, state)
    return d.select("user_id", "frame", "candidate_index")


@query("stream_publish", f"""
SELECT event_id, {codes_sql(("value_too_low", "value < 2"), ("k_too_low", f"{K_SQL} < 10"))} AS reasons FROM events""")
def stream_publish(t):
    out, state = folders(t.spark)

    def build(batch):
        return apply_gates(batch, [Rule("value_too_low", col("value") < 2), Rule("k_too_low", col("k") < 10)]).select("event_id", "reasons")

    return st.run_once(event_stream(t), out, state, build=build).select("event_id", joined("reasons").alias("reasons"))
