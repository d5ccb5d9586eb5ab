"""Numbers of many groups at once inside a task: sorted rows, and where each group begins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.session import join_same, settle

#: Rows that are worked on at once, about; a larger group stands alone. Hot groups that are broadcast, at most.
ROWS, BROADCAST_KEYS = 1 << 17, 100_000


class Segments:
    """Whole groups of a table that is sorted by group."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.table, self.starts = table, starts
        self.sizes = np.diff(np.append(starts, table.num_rows))
        self.group = np.repeat(np.arange(len(starts)), self.sizes)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def renamed(self, **names: str) -> Segments:
        """With columns under other names: ``old="new"``."""
        return Segments(self.table.rename_columns([names.get(c, c) for c in self.table.column_names]), self.starts)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value of each group for each of its rows."""
        return np.repeat(values, self.sizes)

    def sum(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.broadcast_to(values, self.group.shape), self.starts)

    def most(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, self.starts)

    def among(self, keep: np.ndarray) -> tuple[Segments, np.ndarray]:
        """The rows marked, and the groups that have some, by their number here."""
        at = self.group[keep]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        return Segments(self.table.filter(pa.array(keep)), starts), at[starts]

    def quantile(self, values: np.ndarray, keep: np.ndarray, q: float) -> pa.Array:
        """The linear quantile of the values marked, as Spark's ``percentile`` computes it; null where a group has none."""
        at = self.group[keep]
        v = values[keep][np.lexsort((values[keep], at))]
        n = np.bincount(at, minlength=len(self.starts))
        some = n > 0
        place = np.where(some, n - 1, 0) * q
        low, high = np.floor(place), np.ceil(place)
        first = (np.cumsum(n) - n)[some]
        a, b = (v[first + t[some].astype(np.int64)] for t in (low, high))
        out = np.zeros(len(n))
        out[some] = np.where((a == b) | (low == high)[some], a, (high - place)[some] * a + (place - low)[some] * b)
        return pa.array(out, mask=~some)

    def median(self, values: np.ndarray) -> np.ndarray:
        """The linear median."""
        v = values[np.lexsort((values, self.group))]
        low, high = v[self.starts + (self.sizes - 1) // 2], v[self.starts + self.sizes // 2]
        return np.where(self.sizes % 2 == 1, low, low + (high - low) * 0.5)

    def weighted_median(self, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The lowest value at which the cumulative weight reaches half of the total; weights are whole numbers."""
        order = np.lexsort((values, self.group))
        reached = np.cumsum(weights[order])
        before = np.append(0, reached)[self.starts]
        total = reached[self.starts + self.sizes - 1] - before
        enough = np.flatnonzero(2 * (reached - self.spread(before)) >= self.spread(total))
        first = enough[np.searchsorted(enough, self.starts)]
        return values[order[first]]


def by_size(rows: DataFrame, by: Sequence[str], limit: int, fields: Sequence[T.StructField], inside: Callable, across: Callable) -> DataFrame:
    """One row per group: ``by`` and ``fields``. Groups of up to ``limit`` rows are shuffled whole and go through
    ``inside(segments)``, which gives an array for each field (of numpy, not a number: null; or of Arrow), many groups at once. Larger ones go
    through ``across(rows)``, where no task holds a group."""
    by = list(by)
    if not by:
        return by_size(rows.withColumn("_all", F.lit(0)), ["_all"], limit, fields, inside, across).drop("_all")
    schema = T.StructType([rows.schema[c] for c in by] + list(fields))
    rows = settle(rows)
    hot = settle(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*by))
    n = hot.count()
    cold = rows if not n else join_same(rows, F.broadcast(hot) if n <= BROADCAST_KEYS else hot, by, "left_anti")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(table.num_rows, dtype=bool)
            new[:1] = True
            for c in by:
                code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            end = table.num_rows if last else int(starts[-1])
            held = table.slice(end).to_batches()
            starts = starts[starts < end]
            if not len(starts):
                return
            g = Segments(table.slice(0, end).combine_chunks(), starts)
            keys = [g.table.column(c).combine_chunks().take(pa.array(starts)) for c in by]
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                found = inside(g)
            found = [a if isinstance(a, pa.Array) else pa.array(a, mask=np.isnan(a) if a.dtype.kind == "f" else None) for a in found]
            yield pa.RecordBatch.from_arrays(keys + found, names=schema.names)

        n, due = 0, ROWS
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= due:
                yield from give(False)
                n = sum(x.num_rows for x in held)
                due = max(ROWS, 2 * n)
        if n:
            yield from give(True)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cold.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(work, schema)
    return out if not n else out.unionByName(across(join_same(rows, F.broadcast(hot) if n <= BROADCAST_KEYS else hot, by, "left_semi")).select(*schema.names))
