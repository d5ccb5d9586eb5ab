"""From raw documents to packed training sequences: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.llm import langid, linedup, mixing, nearcopies, packing
from clipledger.llm.common import WORD, crc32_column, small_side, staged
from clipledger.llm.queries import held_out, tokenizer_path


def _columns(docs: DataFrame) -> list[str]:
    """The columns of documents, without what a stage before may have added."""
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: those whose text has letters and in which one language has half of the text or
    more. The predicted language becomes ``lang``. Where no document is labelled, nothing can be learned, and all with
    letters stay as they are. Rows are judged one by one: null and empty texts go, repeated rows and null ids do not
    matter, other columns than those of documents are left out, an empty table stays empty."""
    model = langid.fit_languages(docs.where(~held_out("doc_id")))
    docs = docs.select(*_columns(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.identify_rows(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5))
    return kept.withColumn("lang", F.col("lang_pred")).select(*_columns(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier place holds, or holds but for one edit. A document left without words stays as it
    is, empty. Null texts stay null; rows equal in id and text count as one place and lose the same lines; null ids
    come last; an empty table stays empty."""
    out = linedup.drop_repeated_lines(docs.select(*_columns(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the first by id and then by a hash of its text: copies share
    0.8 of their 5-word shingles. Texts without words are one group. What stays is decided by id and text, so rows that
    share an id are judged by their own texts, and of rows equal in both one stays. Rows with a null id stay; an empty
    table stays empty."""
    docs = docs.select(*_columns(docs))
    found = nearcopies.near_copies(docs, words=5, share=0.8)
    marks = found.where("id IS NOT NULL").groupBy("id", "h").agg(F.first("first").alias("first"), F.count("*").alias("rows"))
    gone = marks.where("NOT first").select(F.col("id").alias("doc_id"), F.col("h").alias("_h"))
    twice = small_side(marks.where("first AND rows > 1").select(F.col("id").alias("doc_id"), F.col("h").alias("_h")), 16)
    left = docs.withColumn("_h", F.coalesce(F.xxhash64("text"), F.lit(0))).join(gone, ["doc_id", "_h"], "left_anti")
    alone = left.join(twice, ["doc_id", "_h"], "left_anti")
    return alone.unionByName(left.join(twice, ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h"])).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, and for a partial one the words from its start. Rows
    that share id, source and size share their words evenly, rounded down. Documents without words are never taken;
    null ids and sources are kept apart from others; an empty table stays empty."""
    taken = mixing.mix(docs).groupBy("id", "source", "size").agg((F.sum("taken") / F.count("*")).cast("long").alias("taken"))
    taken = taken.where("taken > 0").select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "taken")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*_columns(docs)).withColumn("size", size).where("size > 0")
    rows = rows.join(taken, rows.doc_id.eqNullSafe(F.col("_id")) & rows.source.eqNullSafe(F.col("_source")) & (rows["size"] == F.col("_size")))
    part = F.col("taken") % F.col("size")
    counts = F.concat(F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("words", F.explode(counts))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row for each piece. Null and empty texts have their end id alone; rows are packed
    one by one, whatever their ids; an empty table gives no rows."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", crc32_column("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", identify_languages), ("line dedup", dedup_lines), ("SimHash near-dedup", dedup_documents), ("mixing", mix_sources), ("packing", pack)]

#: The stages use tokenizers, n-gram models and XXH64, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
