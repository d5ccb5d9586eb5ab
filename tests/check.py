"""Compare registered queries with their SQL: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: Library estimators with own starting points: covered by fixtures, compared by row count only.
NO_SQL = {"kmeans", "train"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def kinds(rows):
    out = {}
    for r in rows:
        for i, v in enumerate(r):
            if v is not None:
                out.setdefault(i, type(v.item() if hasattr(v, "item") else v).__name__)
    return out


def compare(spark, con, name, path, queries, oracles) -> tuple[bool, str]:
    df = queries[name](spark, path)
    cols = sorted(df.columns)
    got_raw = [tuple(r) for r in df.select(*cols).collect()]
    if name not in oracles:
        return len(got_raw) > 0, f"rows={len(got_raw)} (no SQL)"
    rel = con.execute(oracles[name])
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    pick = [names.index(c) for c in cols]
    want_raw = [tuple(r[i] for i in pick) for r in rows]
    got = sorted([tuple(map(norm, r)) for r in got_raw], key=str)
    want = sorted([tuple(map(norm, r)) for r in want_raw], key=str)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"rows {len(got)} vs {len(want)}; cols {cols}; diff {sum(g != w for g, w in zip(got, want))}: {bad}"
    kg, kw = kinds(got_raw), kinds(want_raw)
    if kg != kw:
        return False, f"types differ {[(cols[i], kg.get(i), kw.get(i)) for i in kg if kg.get(i) != kw.get(i)]}"
    return len(got) > 0, f"rows={len(got)}"


def main(argv):
    from clipledger.session import HOT_ROWS_CONF, build_session

    path = "/root/testdata/sf0.01"
    only = []
    hot = None
    for a in argv:
        if a.startswith("hot="):
            hot = a[4:]
        elif a.startswith("/"):
            path = a
        else:
            only.append(a)
    from clipledger.plans import ORACLES, QUERIES

    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    if hot:
        spark.conf.set(HOT_ROWS_CONF, hot)
    con = connect(path)
    names = [n for n in QUERIES if not only or n in only or QUERIES[n].__module__ in only]
    failed = []
    for n in names:
        t = time.time()
        try:
            ok, note = compare(spark, con, n, path, QUERIES, ORACLES)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
            if len(names) == 1:
                traceback.print_exc()
        print(f"{'ok  ' if ok else 'FAIL'} {n:22s} {time.time() - t:6.1f}s {note[:1500]}", flush=True)
        if not ok:
            failed.append(n)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
