"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.session import checkpoint_folder, settle

LEAST = -(2**63)
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """The named columns under new names: ``pick(df, id="doc_id")``. All others, whatever they are called, are left out."""
    return df.select(*[df[f"`{c}`"].alias(n) for n, c in cols.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame) -> DataFrame:
    """Write rows as Parquet into the application's shared folder and read them back: a lineage cut like
    ``settle``, but columnar and compressed, for rows that carry texts or binaries."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, limit: int = 48 << 20) -> DataFrame:
    """One side of a join, computed once and counted: marked for broadcast if its rows of about ``row_bytes`` stay
    below ``limit`` bytes, else left to a shuffled join. Both give the same rows."""
    df = settle(df)
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def per_worker(key: tuple, make: Callable):
    """``make()`` once per Python worker process; later tasks of the process find it again."""
    kept = sys.modules.setdefault("_clipledger_worker", types.ModuleType("_clipledger_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def dealt_in_order(df: DataFrame, key: str, *ties: str, ahead: bool = False, parts: int | None = None) -> DataFrame:
    """Rows in ascending order of the long column ``key`` (null first, equal keys by ``ties``): partition i holds keys
    below those of partition i + 1, sorted. The cut points are quantiles of ``key`` alone, so the sampling pass reads
    one column, and rows are shuffled once.

    With ``ahead``, a boolean column ``ahead`` is added and each partition ends with a copy, marked true, of the rows
    that share the first key of the next partition with rows (the last: of the first one).
    """
    n = parts or partitions(df.sparkSession)
    own = F.coalesce(F.col(key), F.lit(LEAST))
    at = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.when(own > LEAST, own), at, 100 * n + 10_000)).first()[0] if at else None
    cuts = np.array(sorted(set(found or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="left").astype(np.int32))

    out = df.withColumn("__part", place(own))
    if not ahead:
        return out.repartitionById(len(cuts) + 1, "__part").sortWithinPartitions("__part", key, *ties).drop("__part")
    firsts = sorted(out.select("__part", own.alias("__k")).groupBy("__part").agg(F.min("__k").alias("__k")).collect())
    before = {r["__k"]: firsts[i - 1]["__part"] for i, r in enumerate(firsts)}
    keys = np.array(sorted(before), dtype=np.int64)
    to = np.array([before[int(k)] for k in keys], dtype=np.int32)

    @F.pandas_udf("int")
    def earlier(k: pd.Series) -> pd.Series:
        i = np.searchsorted(keys, k.to_numpy())
        hit = (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] == k.to_numpy())
        return pd.Series(np.where(hit, to[np.minimum(i, len(keys) - 1)], -1).astype(np.int32))

    if not firsts:
        return out.withColumn("ahead", F.lit(False)).drop("__part")
    copies = F.array(F.struct(F.col("__part").alias("p"), F.lit(False).alias("a")), F.struct(earlier(own).alias("p"), F.lit(True).alias("a")))
    out = out.withColumn("__to", F.explode(copies)).where("__to.p >= 0")
    out = out.withColumn("__part", F.col("__to.p")).withColumn("ahead", F.col("__to.a")).drop("__to")
    return out.repartitionById(len(cuts) + 1, "__part").sortWithinPartitions("__part", "ahead", key, *ties).drop("__part")


def crc32_column(ids: Column | str) -> Column:
    """Unsigned CRC-32 of a binary column; of no bytes: 0."""
    return F.coalesce(F.crc32(ids), F.lit(0)).cast("long")
