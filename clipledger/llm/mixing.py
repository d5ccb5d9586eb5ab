"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import WORD, pick
from clipledger.session import join_same, settle

BUCKET_DIGITS = 3


def _places(sources: DataFrame) -> DataFrame:
    """Add ``place``: the source's position by code point from 0, null last. Ranks are counted within ranges of the
    sorted sources and shifted by the ranges' sizes, so no task holds all of them."""
    at = settle(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    at = at.withColumn("part", F.shiftright("at", 33))
    sizes = at.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each partition
    before = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return at.join(before, "part").withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def fill(sources: DataFrame, epochs: int) -> DataFrame:
    """Capped water-filling. ``sources`` has source, source_size (long) and weight (long). Adds ``target`` (double):
    the total of all sizes, split by weight; a source above ``epochs`` times its size is clamped there,
    and what it leaves is split again by the weights of the others, until none is above. Each round reads two sums;
    it clamps at least one source, and usually most of those that will be."""
    now = sources.withColumn("clamped", F.col("source_size") == 0)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        kept, rest = now.agg(F.sum(F.when(F.col("clamped"), F.col("source_size") * epochs)), F.sum(F.when(~F.col("clamped"), F.col("weight")))).first()
        left = total - (kept or 0)
        if not rest or left <= 0:
            goal = F.when(F.col("clamped"), (F.col("source_size") * epochs).cast("double")).otherwise(F.lit(0.0))
            return now.withColumn("target", goal).drop("clamped")
        goal = F.lit(left).cast("double") * F.col("weight") / F.lit(rest)
        over = ~F.col("clamped") & (goal > F.col("source_size") * epochs)
        nxt = settle(now.withColumn("over", over).withColumn("clamped", F.col("clamped") | F.col("over")))
        if nxt.where("over").isEmpty():
            return now.withColumn("target", F.when(F.col("clamped"), (F.col("source_size") * epochs).cast("double")).otherwise(goal)).drop("clamped")
        now = nxt.drop("over")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), epochs: int = 3, seed: int = 7) -> DataFrame:
    """How often each document is taken: ``id``, ``source``, ``key``, ``size`` (words), ``source_size``, ``target``
    (the source's), ``taken`` (words, repeats counted).

    Sources in code-point order, null last, weigh ``weights`` in turn. A source's target over its size gives whole
    epochs, which every document gets, and a rest: documents in seeded order (MD5 of seed and id) are taken once more
    while the rest lasts, the last of them in part, from its start. So each source's words meet its target, rounded
    down. The order is cut into buckets of the digest, and the running sum is one of bucket sums and of rows in a
    bucket, so a source with any share of the rows is spread.

    Null and empty texts have size 0 and are never taken. Null ids order by the empty id. Rows with the same id and
    source are ordered by size; rows equal in all three may share their part either way. Empty table: no rows.
    ``key`` (MD5 hex) identifies the seeded order.
    """
    rows = pick(docs, id=id_col, text=text_col, source=source_col)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows = settle(rows.select("id", "source", key.alias("key"), size.alias("size")))
    sources = _places(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = settle(fill(sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))), epochs))
    # words left for the last, partial epoch
    full = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.select("source", "source_size", "target", full.alias("full"), (F.floor("target").cast("long") - full * F.col("source_size")).alias("quota"))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket")
    sums = sums.select("source", "bucket", (F.sum("in_bucket").over(before) - F.col("in_bucket")).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = join_same(join_same(rows, sums, ["source", "bucket"]), sources, ["source"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("before") - F.col("inside")))
    return rows.select("id", "source", "key", "size", "source_size", "target", (F.col("size") * F.col("full") + extra).cast("long").alias("taken"))
