"""Statistics over all pairs of a group without ever forming the pairs as rows.

Rows are packed into blocks of bounded size; every block meets every other block of its group by an equi-join on
the block number, and the task that holds two blocks returns only counts of merged distances.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.operators.groups import by_group
from clipledger.operators.segments import Segments, by_size
from clipledger.session import hot_limit, join_same, settle

#: Rows of a group whose pairs one task may measure.
PAIRED = 2048
BLOCK = 256  # rows whose distances to another such block a task holds at once
WIDEST = 32_768  # rows of a packed range at most
BIN_SHIFT = 44  # keeps sign, exponent and 8 mantissa bits: an order-preserving bin of doubles


def _grid(df: DataFrame, by: list[str], vector: Column, order: Sequence) -> DataFrame:
    """One row per pair of row ranges (bi <= bj) of a group, with both ranges' vectors as flat arrays.

    A group is cut into about sqrt(2 * tasks) ranges, so its range pairs fill all tasks and a row is copied that often,
    however many rows there are; small groups are one range, and ranges stay within ``BLOCK`` and ``WIDEST`` rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, math.ceil(math.sqrt(2 * n)))
    d = df.select(*by, *[c for c in order if c not in by], vector.alias("_v"))
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(WIDEST), F.ceil(F.col("_all") / side)))
    d = by_group(d, by, lambda d, g: g.attach(g.rank(d, order, "_i"), _all=F.count("*"))).withColumn("bj", F.floor((F.col("_i") - 1) / size))
    packed = settle(d.groupBy(*by, "bj").agg(F.flatten(F.collect_list("_v")).alias("b"), F.count("*").alias("kb")))
    last = packed.groupBy(*by).agg(F.max("bj").alias("_last"))
    left = join_same(packed, last, by).select(*by, F.col("bj").alias("bi"), F.explode(F.sequence("bj", "_last")).alias("bj"), F.col("b").alias("a"), F.col("kb").alias("ka"))
    # explicit partitions: the rows are few but each is worth a range of distances
    return join_same(left.repartition(n, *by, "bi", "bj"), packed, by + ["bj"])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean absolute differences of all rows of a and b."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):  # one dimension at a time keeps memory at block x block
        total += np.abs(a[:, k : k + 1] - b[:, k])
    return total / max(a.shape[1], 1)


def _slopes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slopes between all points (x, y) of a and b; NaN where x does not differ."""
    run = b[:, 0] - a[:, :1]
    flat = np.abs(run) <= 1e-12
    return np.where(flat, np.nan, (b[:, 1] - a[:, 1:]) / np.where(flat, 1.0, run))


def _of_pairs(row, measure: Callable) -> Iterator[np.ndarray]:
    """Measures of all row pairs of two ranges, or of one range with itself, a block of each at a time; no NaN."""
    a = np.asarray(row.a, dtype=np.float64).reshape(int(row.ka), -1)
    b = np.asarray(row.b, dtype=np.float64).reshape(int(row.kb), -1)
    for i in range(0, len(a), BLOCK):
        for j in range(i if row.bi == row.bj else 0, len(b), BLOCK):
            m = measure(a[i : i + BLOCK], b[j : j + BLOCK])
            m = m[np.triu_indices(len(m), k=1)] if row.bi == row.bj and i == j else m.ravel()
            yield m[~np.isnan(m)] + 0.0


def _bin(values: np.ndarray) -> np.ndarray:
    bits = values.view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> BIN_SHIFT


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys."""
    keys, counts = np.empty(0), np.empty(0, dtype=np.int64)
    for k, n in parts:
        keys, at = np.unique(np.concatenate([keys.astype(k.dtype), k]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    return keys, counts


def _per_pair(by: list[str], fn: Callable):
    """Apply ``fn(row) -> dict of arrays`` to each range pair and repeat its group keys."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = pd.DataFrame(fn(row))
                for b in by:
                    out[b] = getattr(row, b)
                yield out[[*by, *[c for c in out.columns if c not in by]]]

    return run


def _pair_quantile(df: DataFrame, by: Sequence[str], vector: Column, order: Sequence, q: float, name: str, measure: Callable) -> DataFrame:
    """Exact linear quantile of a measure over all pairs of a group; groups without a pair are absent. Groups up to
    PAIRED rows are paired inside a task. Larger ones are cut into ranges: pass one counts measures per bin, pass two
    returns only the merged measures of the one or two bins that hold the wanted ranks."""
    by = list(by)
    rows = df.select(*by, *[c for c in order if c not in by], vector.alias("_v"))

    def inside(g: Segments) -> list[np.ndarray]:
        lists = g.table.column("_v").combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        out = np.full(len(g.starts), np.nan)
        for k, (a, n) in enumerate(zip(g.starts.tolist(), g.sizes.tolist())):
            one = SimpleNamespace(a=flat[ends[a] : ends[a + n]], b=flat[ends[a] : ends[a + n]], ka=n, kb=n, bi=0, bj=0)
            found = np.concatenate(list(_of_pairs(one, measure)) or [np.zeros(0)])
            if len(found):
                low, high = np.partition(found, sorted({int(np.floor(q * (len(found) - 1))), int(np.ceil(q * (len(found) - 1)))}))[[int(np.floor(q * (len(found) - 1))), int(np.ceil(q * (len(found) - 1)))]]
                part = q * (len(found) - 1) - np.floor(q * (len(found) - 1))
                out[k] = low * (1 - part) + high * part
        return [out]

    limit = min(PAIRED, hot_limit(df.sparkSession))
    found = by_size(rows, by, limit, [T.StructField(name, T.DoubleType())], inside, lambda d: _across(d, by, order, q, name, measure))
    return found.where(F.col(name).isNotNull())


def _across(df: DataFrame, by: list[str], order: Sequence, q: float, name: str, measure: Callable) -> DataFrame:
    pairs = _grid(df, by, F.col("_v"), order)
    keys = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)

    def bins(row):
        b, n = _merged(np.unique(_bin(m), return_counts=True) for m in _of_pairs(row, measure))
        return {"bin": b.astype(np.int64), "n": n}

    def picked(row):
        def near(m):
            b = _bin(m)
            return np.unique(m[(b == row.lo_bin) | (b == row.hi_bin)], return_counts=True)

        v, n = _merged(near(m) for m in _of_pairs(row, measure))
        return {"v": v.astype(np.float64), "n": n, "skipped": np.full(len(v), row.skipped), "total": np.full(len(v), row.total)}

    at = F.lit(float(q)) * (F.col("total") - 1)

    def holds(p):
        return (p >= F.col("hi") - F.col("n")) & (p < F.col("hi"))

    hist = pairs.mapInPandas(_per_pair(by, bins), f"{keys}bin long, n long").groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    every = Window.partitionBy(*by)  # at most a few hundred thousand bins in a group, whatever its size
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(*by, "bin", "n", F.sum("n").over(upto).alias("hi"), F.sum("n").over(every).alias("total"))
    span = hist.where(holds(F.floor(at)) | holds(F.ceil(at))).groupBy(*by).agg(
        F.min("bin").alias("lo_bin"), F.max("bin").alias("hi_bin"), F.min(F.col("hi") - F.col("n")).alias("skipped"), F.max("total").alias("total"))
    near = join_same(pairs, settle(span), by).mapInPandas(_per_pair(by, picked), f"{keys}v double, n long, skipped long, total long")
    near = near.groupBy(*by, "v").agg(F.sum("n").alias("n"), F.max("skipped").alias("skipped"), F.max("total").alias("total"))
    cum = by_group(settle(near), by, lambda d, g: g.running(d, ["v"], _up=F.col("n"))).withColumn("hi", F.col("_up") + F.col("skipped"))
    out = cum.groupBy(*by).agg(
        F.max(F.when(holds(F.floor(at)), F.col("v"))).alias("_a"), F.max(F.when(holds(F.ceil(at)), F.col("v"))).alias("_b"), F.max(at - F.floor(at)).alias("_f"))
    return out.select(*by, (F.col("_a") * (1 - F.col("_f")) + F.col("_b") * F.col("_f")).alias(name))


def pair_quantile(df: DataFrame, by: Sequence[str], vector: str, order: Sequence, q: float, name: str) -> DataFrame:
    """Exact linear quantile of the mean absolute difference over all pairs of a group. Groups with fewer than two
    rows are absent."""
    return _pair_quantile(df, by, F.transform(vector, lambda x: x.cast("double")), order, q, name, _distances)


def quarter_turns(side: int) -> list[np.ndarray]:
    """Where each pixel of a square image comes from after 0, 1, 2 and 3 quarter turns against the clock."""
    at = np.arange(side * side).reshape(side, side)
    return [np.rot90(at, k).ravel() for k in range(4)]


def _aligned(side: int) -> Callable:
    """Distance of silhouettes (0 or more a pixel, then appearance values) under the best of four quarter turns of the
    second: one less their overlap over their union, chosen by that plus 0.15 times the distance of appearances. Masks
    are packed, so a pair of words is compared at once."""
    turns, n = quarter_turns(side), side * side

    def packed(rows: np.ndarray) -> np.ndarray:
        bits = np.packbits(rows > 0, axis=1)
        return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)

    def measure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        one = packed(a[:, :n])
        looks = np.clip(1 - a[:, n:] @ b[:, n:].T, 0, 2)
        best = cost = None
        for turn in turns:
            two = packed(b[:, :n][:, turn])
            both, either = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
            for w in range(one.shape[1]):
                both += np.bitwise_count(one[:, w, None] & two[None, :, w])
                either += np.bitwise_count(one[:, w, None] | two[None, :, w])
            far = np.where(either > 0, 1 - both / np.maximum(either, 1), 0.0)
            if best is None:
                best, cost = far, far + 0.15 * looks
            else:
                nearer = far + 0.15 * looks < cost
                best, cost = np.where(nearer, far, best), np.minimum(cost, far + 0.15 * looks)
        return best

    return measure


def aligned_quantile(df: DataFrame, by: Sequence[str], silhouette: str, appearance: str, side: int, order: Sequence, q: float, name: str) -> DataFrame:
    """Exact linear quantile of the distance of square silhouettes, each pair in its best quarter turn, over all pairs
    of a group. ``silhouette`` holds side * side values, ``appearance`` a vector of unit length."""
    both = F.transform(F.concat(F.col(silhouette).cast("array<double>"), F.col(appearance).cast("array<double>")), lambda x: x)
    return _pair_quantile(df, by, both, order, q, name, _aligned(side))


def pair_slope_median(df: DataFrame, by: Sequence[str], x: str, y: str, order: Sequence, name: str) -> DataFrame:
    """Exact median slope over all pairs of a group's points that differ in x. Groups without such a pair are absent."""
    return _pair_quantile(df, by, F.array(F.col(x), F.col(y)), order, 0.5, name, _slopes)
