"""Registered queries of the operators in this folder: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.llm import langid, licenses, linedup, mixing, packing, periodic, phrases, pieces, simhash, spelling, substrings, tokenfiles, topk
from clipledger.llm.common import crc32_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed public tokenizers lies, on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, table: str = "documents", sql: str | None = None):
    def wrap(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_pack_sequences")
def pack_sequences(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), size=2048, end_id=1)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", crc32_column("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_simhash_components")
def simhash_components(docs: DataFrame) -> DataFrame:
    found = simhash.near_duplicates(docs, words=3, bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_remove_repeats")
def remove_repeats(docs: DataFrame) -> DataFrame:
    return substrings.remove_repeats(docs).withColumnRenamed("id", "doc_id")


@query("op4_token_files")
def token_files(docs: DataFrame) -> DataFrame:
    folder = tokenfiles.token_folder(docs.sparkSession)
    manifest = tokenfiles.write_tokens(docs, tokenizer_path("byte_bpe_50k.json"), folder, end_id=0, null_ids=True)
    return tokenfiles.read_tokens(manifest, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", crc32_column("ids").alias("ids_crc32"))


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, lower(trim(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), judged AS (SELECT * FROM lines WHERE line <> ''),
one AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS place, count(*) AS c FROM judged GROUP BY line),
long AS (SELECT * FROM one WHERE n >= 20),
keys AS (
  SELECT line, n, place, 'h' || substr(line, 1, n // 2) AS half FROM long UNION SELECT line, n, place, 'h' || substr(line, 1, (n - 1) // 2) FROM long
  UNION SELECT line, n, place, 't' || substr(line, n // 2 + 1) FROM long UNION SELECT line, n, place, 't' || substr(line, (n - 1) // 2 + 2) FROM long
),
near AS (
  SELECT DISTINCT x.line FROM keys x JOIN keys y ON x.half = y.half AND x.line <> y.line AND abs(x.n - y.n) <= 1 AND y.place < x.place
  WHERE len(list_filter(range(1, least(x.n, y.n) + 2), lambda p: substr(x.line, 1, p - 1) = substr(y.line, 1, p - 1)
    AND substr(x.line, CASE WHEN x.n >= y.n THEN p + 1 ELSE p END) = substr(y.line, CASE WHEN y.n >= x.n THEN p + 1 ELSE p END))) > 0
),
gone AS (SELECT j.doc_id, j.pos FROM judged j JOIN one o USING (line) WHERE (j.doc_id, j.pos) <> o.place OR j.line IN (SELECT line FROM near)),
marks AS (SELECT doc_id, list(pos ORDER BY pos) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN m.removed IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(m.removed, i - 1)), chr(10)) END AS text,
  coalesce(len(m.removed), 0) AS n_removed, coalesce(array_to_string(m.removed, ','), '') AS removed
FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
"""


@query("op5_line_dedup", sql=LINES_SQL)
def line_dedup(docs: DataFrame) -> DataFrame:
    out = linedup.drop_repeated_lines(docs)
    return out.select("doc_id", "text", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query("op6_phrase_fingerprints")
def phrase_fingerprints(docs: DataFrame) -> DataFrame:
    out = phrases.compare_with_next(docs)
    digest = F.sha2(F.col("edited_text").cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), "n_chars", digest.alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('7-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, ss, [5, 2, 1][place % 3 + 1] AS weight, row_number() OVER (ORDER BY 3.0 * ss / [5, 2, 1][place % 3 + 1], source) AS i FROM s),
c AS (
  SELECT *, CAST((SELECT sum(ss) FROM s) - coalesce(sum(3 * ss) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM w
), k AS (SELECT rest, ws, i AS edge FROM c WHERE CAST(rest AS DOUBLE) * weight / ws <= 3 * ss AND ss > 0 ORDER BY i LIMIT 1),
t AS (
  SELECT source, ss, CASE WHEN i < (SELECT edge FROM k) OR ss = 0 THEN CAST(3 * ss AS DOUBLE) ELSE CAST((SELECT rest FROM k) AS DOUBLE) * weight / (SELECT ws FROM k) END AS target FROM c
), q AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target) AS BIGINT) // ss ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT r.doc_id, r.size, q.ss AS source_size, q.target, CAST(r.size * q.whole + greatest(0, least(r.size, CAST(floor(q.target) AS BIGINT) - q.whole * q.ss - r.before)) AS BIGINT) AS taken
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source
"""


@query("op7_mix_sources", sql=MIX_SQL)
def mix_sources(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, weights=(5, 2, 1), epochs=3).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op8_exact_topk", table="embeddings", sql=TOPK_SQL)
def exact_topk(vectors: DataFrame) -> DataFrame:
    return topk.top_k(topk.index(topk.quantised(vectors)), k=5, every=50)


def _licenses_sql() -> str:
    """Brute force: every line's set of words against every template."""
    gap = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    words = lambda e: f"' ' || trim(regexp_replace(lower({e}), '{gap}', ' ', 'g'), ' ') || ' '"
    places = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES.items())
    rows = ", ".join(f"('{label}', {sorted(set(t.split()))})" for label, t in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split({words("coalesce(text, '')")}, ' '), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT * FROM (VALUES {places}) AS t(phrase, label, n)),
hit AS (
  SELECT doc_id, label, i - 1 AS spot FROM (SELECT d.doc_id, d.ws, p.*, unnest(range(1, len(ws) - n + 2)) AS i FROM d, p WHERE list_contains(ws, string_split(phrase, ' ')[1]))
  WHERE array_to_string(ws[i:i + n - 1], ' ') = phrase
), base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM hit GROUP BY doc_id),
l AS (SELECT doc_id, list_distinct(string_split({words("line")}, ' ')) AS have FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
t AS (SELECT * FROM (VALUES {rows}) AS t(label, ws)),
m AS (SELECT doc_id, label, len(list_intersect(have, ws)) AS c, len(ws) AS n FROM l, t WHERE len(list_intersect(have, ws)) >= ceil(0.8 * len(ws) - 1e-9)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(c AS DOUBLE) / n) AS best FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(more.best, 0)::DOUBLE END AS score
FROM d LEFT JOIN base b USING (doc_id) LEFT JOIN more USING (doc_id)
"""


@query("op9_license_scan", sql=_licenses_sql())
def license_scan(docs: DataFrame) -> DataFrame:
    out = licenses.scan_licenses(docs, wrapped=True)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def held_out(doc_id) -> F.Column:
    """A fifth of the documents, by the remainder of an id's checksum."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 0


@query("op10_language_mixture")
def language_mixture(docs: DataFrame) -> DataFrame:
    model = langid.fit_languages(docs.where(~held_out("doc_id")))
    out = langid.identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where in a tenth of the documents the words from one place on repeat with a period:
    h is the CRC-32 of the id, g = floor(h / 10), and if 10 divides h, each word i >= a = g % n becomes word
    a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w")
    rows = rows.select("doc_id", "text", "w", "g", n.alias("n"), F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.select("*", p.alias("p"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    new = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_runs(docs: DataFrame) -> DataFrame:
    out = periodic.find_runs(with_repeats(docs), least=6, exponent=4)

    def order(x: F.Column, y: F.Column) -> F.Column:
        one, two = x["length"] * y["period"], y["length"] * x["period"]
        later = F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"]))
        return F.when(one == two, later).otherwise(F.signum(two - one)).cast("int")

    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.select("id", "runs", best.alias("best"), lines.alias("lines"), "collapsed")
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_spelling_variants")
def spelling_variants(docs: DataFrame) -> DataFrame:
    return spelling.group_variants(docs, least=7, often=2, times=10, slips=31)


@query("op13_sentence_pieces")
def sentence_pieces(docs: DataFrame) -> DataFrame:
    out = pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), end_id=2)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
