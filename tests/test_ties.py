"""Queries against their SQL on tables made to tie where order of rows or size of groups once decided."""

from pathlib import Path

import numpy as np
import pandas as pd

from check import TABLES, compare, connect
from clipledger.plans import ORACLES, QUERIES

SMALL = Path("/root/testdata/sf0.001")


def changed(folder, **tables: pd.DataFrame) -> str:
    """A folder of the smallest tables in which some are replaced."""
    for t in TABLES:
        if t in tables:
            tables[t].to_parquet(folder / f"{t}.parquet", coerce_timestamps="us")
        else:
            (folder / f"{t}.parquet").symlink_to(SMALL / f"{t}.parquet")
    return str(folder)


def table(name: str) -> pd.DataFrame:
    return pd.read_parquet(SMALL / f"{name}.parquet")


def test_backend_rollup_mean_at_the_limit_is_not_below_it(spark, tmp_path):
    rng, rows = np.random.default_rng(1), table("lineitem")
    base = np.array([0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1, 0.02, 0.06])  # 0.0525 on average
    assert round(base.sum() * 100) == 63
    n = len(rows) // 12 // 2 * 12
    rows = rows.iloc[: n + 1].copy()
    rows["l_linestatus"] = "F"
    rows["l_suppkey"] = np.append(np.arange(n) // 12, 1_000_000)
    rows["l_discount"] = np.append(np.concatenate([rng.permutation(base) for _ in range(n // 12)]), 0.05)
    path = changed(tmp_path, lineitem=rows)
    ok, note = compare(spark, connect(path), "backend_rollup", path, QUERIES, ORACLES)
    assert ok, note
    assert QUERIES["backend_rollup"](spark, path).first().aligned_views == 1


def test_freeze_of_groups_that_need_three_turns(spark, monkeypatch):
    from clipledger.operators import lineage

    monkeypatch.setattr(lineage, "DIGEST_BLOCK", 7)  # some 300 rows a group: 43 blocks, 7, 1
    sql = {"freeze": ORACLES["freeze"].replace("// 1000", "// 7")}
    assert sql["freeze"] != ORACLES["freeze"]
    ok, note = compare(spark, connect(str(SMALL)), "freeze", str(SMALL), QUERIES, sql)
    assert ok, note


def events(rows) -> pd.DataFrame:
    """Events of (user, hours from the start, kind, k)."""
    d = pd.DataFrame(rows, columns=["user_id", "hour", "event_type", "k"])
    ts = (pd.Timestamp("2024-01-01") + pd.to_timedelta(d.hour, "h")).astype("datetime64[us]")
    d = pd.DataFrame({"event_id": np.arange(len(d)), "ts": ts, "user_id": d.user_id, "event_type": d.event_type, "value": 1.0, "props": [f'{{"k": {k}}}' for k in d.k]})
    return d.astype({"event_id": "int64", "user_id": "int64"})


def tied_kinds(step: float) -> pd.DataFrame:
    """Users whose errors have the values of their clicks in another order."""
    rng, rows = np.random.default_rng(2), []
    for u in range(300):
        k = rng.integers(20, 100, 7)
        for kind in ("error", "click"):
            rows += [(u, i * step, kind, int(x)) for i, x in enumerate(rng.permutation(k))]
    return events(rows)


def test_hints_of_equal_scores_go_by_kind(spark, tmp_path):
    path = changed(tmp_path, events=tied_kinds(24))
    ok, note = compare(spark, connect(path), "hints", path, QUERIES, ORACLES)
    assert ok, note
    assert {(r.hint, r.margin) for r in QUERIES["hints"](spark, path).collect()} == {("click", 0.0)}


def test_stream_hint_winner_of_equal_scores_goes_by_kind(spark, tmp_path):
    path = changed(tmp_path, events=tied_kinds(1))
    ok, note = compare(spark, connect(path), "stream_hint_winner", path, QUERIES, ORACLES)
    assert ok, note
    assert {(r.hint, r.margin) for r in QUERIES["stream_hint_winner"](spark, path).collect()} == {("click", 0.0)}


def test_loop_closure_peak_at_the_limit_is_not_closed(spark, tmp_path):
    rng, rows, want = np.random.default_rng(4), [], {}
    for u in range(200):
        five = rng.multinomial(100, [0.2] * 5)  # any five in a row: 1 - 100 / 500, in another order each
        away = np.concatenate([[0], np.resize(five, 20), [90] * 4])
        rows += [(u, i, "click", int(x)) for i, x in enumerate(away)]
        pad = np.pad(away, 2, mode="edge")
        sums = np.array([pad[i : i + 5].sum() for i in range(25)])[14:]
        assert sums.min() == 100
        want[u] = (14 + int(sums.argmin()), False)
    path = changed(tmp_path, events=events(rows))
    ok, note = compare(spark, connect(path), "loop_closure", path, QUERIES, ORACLES)
    assert ok, note
    assert {r.user_id: (r.closure_frame, r.closed) for r in QUERIES["loop_closure"](spark, path).collect()} == want
