"""Plug-in point for user-supplied predictors, their contract, reuse of stored results, and custom aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.functions.rules import Rule, apply_gates
from clipledger.operators.lineage import audit_sets
from clipledger.session import join_same, spread_groups

#: Rows of a task that become states at once.
PARTIAL_ROWS = 1 << 18


class Predictor(Protocol):
    """What a predictor offers. It is pickled to the executors; models are loaded there, once per task."""

    name: str

    def is_available(self) -> bool: ...

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def predict(df: DataFrame, predictor: Predictor, ids: Sequence[str], inputs: Sequence[str], schema: str) -> DataFrame:
    """Run a predictor over Arrow batches. ``schema`` names its output columns; ids are added and must come back
    unchanged and in order."""
    ids = list(ids)
    slim = df.select(*ids, *inputs)
    head = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches):
        if not predictor.is_available():
            raise RuntimeError(f"predictor {predictor.name} is not available on this executor")
        for pdf in batches:
            out = predictor.predict(pdf)
            if len(out) != len(pdf):
                raise ValueError(f"predictor {predictor.name} returned {len(out)} rows for {len(pdf)}")
            for c in ids:
                if c in out.columns and list(out[c]) != list(pdf[c]):
                    raise ValueError(f"predictor {predictor.name} changed {c}")
            yield pd.concat([pdf[ids].reset_index(drop=True), out.drop(columns=[c for c in ids if c in out.columns]).reset_index(drop=True)], axis=1)

    return slim.mapInPandas(run, f"{head}, {schema}")


def check_predictions(df: DataFrame) -> DataFrame:
    """Contract of dense predictions (backend, h, w, values, representation): two-dimensional, non-empty, finite,
    positive if metric, and one representation per backend."""
    kinds = df.groupBy("backend").agg(F.count_distinct("representation").alias("_kinds"))
    j = join_same(df, kinds, ["backend"])
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return apply_gates(j, [
        Rule("empty_prediction", (F.col("h") <= 0) | (F.col("w") <= 0) | (F.size("values") == 0)),
        Rule("shape_mismatch", F.size("values") != F.col("h") * F.col("w")),
        Rule("not_finite", ~finite),
        Rule("not_positive", (F.col("representation") == "metric") & F.exists("values", lambda x: x <= 0)),
        Rule("unknown_representation", ~F.col("representation").isin("metric", "relative_inverse")),
        Rule("mixed_representation", F.col("_kinds") > 1),
    ]).drop("_kinds")


def reuse_plan(expected: DataFrame, cache: DataFrame, by: Sequence[str], key: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Per clip: whether the stored predictions cover exactly the expected frames, and how many must be computed."""
    by = list(by)
    d = audit_sets(expected, cache, [*by, *key], compare)
    stale = F.exists("reasons", lambda r: r != "unexpected")
    return d.groupBy(*by).agg(F.bool_and("same").alias("reuse"), F.count(F.when(stale, 1)).alias("to_compute"), F.count(F.when(F.array_contains("reasons", "unexpected"), 1)).alias("unexpected"))


def predict_missing(df: DataFrame, cache: DataFrame, predictor: Predictor, ids: Sequence[str], inputs: Sequence[str], compare: Sequence[str], schema: str) -> DataFrame:
    """Stored predictions where id and input hashes match, fresh ones for all other rows."""
    keys = [*ids, *compare]
    todo = join_same(df, cache.select(*keys), keys, "left_anti")
    kept = join_same(cache, df.select(*keys), keys, "left_semi")
    fresh = join_same(predict(todo, predictor, ids, inputs, schema), todo.select(*keys), list(ids))
    return kept.select(*fresh.columns).unionByName(fresh)


def merge_aggregate(df: DataFrame, by: Sequence[str], partial: Callable, merge: Callable, finish: Callable, state: str, result: str) -> DataFrame:
    """User-defined aggregate with partial states.

    ``partial(groups) -> frame`` turns rows into states, ``merge(groups) -> frame`` joins states: both get a
    ``DataFrameGroupBy`` and give a row for each group, so that all groups at hand are worked on at once.
    ``finish(states) -> frame`` gives the results of a frame of states. A task reduces its rows in stretches of
    PARTIAL_ROWS; what is shuffled is a state per key and stretch, and a key's states are joined as they come, so no group
    is held whole and groups of any size take the same way.
    """
    by = list(by)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    grouped = lambda pdf: pdf.groupby(by, dropna=False, sort=False)

    def start(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= PARTIAL_ROWS:
                yield partial(grouped(pd.concat(held))).reset_index()
                held, n = [], 0
        if n:
            yield partial(grouped(pd.concat(held))).reset_index()

    def join(batches):
        """States sorted by key: the last key of a batch may go on in the next one."""
        last = None
        for pdf in batches:
            if len(pdf):
                now = merge(grouped(pdf if last is None else pd.concat([last, pdf]))).reset_index()
                last = now[-1:]
                if len(now) > 1:
                    yield end(now[:-1])
        if last is not None:
            yield end(last)

    def end(states):
        return pd.concat([states[by], finish(states)], axis=1)

    states = spread_groups(df.mapInPandas(start, f"{keys}, {state}"), by).sortWithinPartitions(*by)
    return states.mapInPandas(join, f"{keys}, {result}")
