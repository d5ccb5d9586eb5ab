"""Steps whose cost once grew faster than their rows: results as before, by ways that hold at size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clipledger.operators import aggregates as ag, fits, graph as gr, groups as gp, joins as jn, models as md
from clipledger.operators import predict as pr
from clipledger.plans import QUERIES, catalog, graphs as pg
from clipledger.sources import readers as rd
from clipledger.streaming import streams as st


def test_aggregate_works_on_all_groups_at_once(spark):
    """One call for many groups, and states of a key that stand in several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.range(0, 5000, 1, 4).select((F.col("id") % 37).alias("k"), F.col("id").cast("double").alias("v")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 3D AS v"))

        def partial(g):
            return g.agg(n=("v", "size"), s=("v", "sum"))

        def merge(g):
            return g.agg({"n": "sum", "s": "sum"})

        def finish(d):
            return pd.DataFrame({"mean": d["s"] / d["n"], "n": d["n"]})

        got = pr.merge_aggregate(d, ["k"], partial, merge, finish, "n long, s double", "mean double, n long")
        want = d.groupBy("k").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_work_on_the_edges_that_are_left(spark, monkeypatch):
    """Random graphs, a path, a star and loops as by union-find; the table of edges shrinks from round to round."""
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 400, (330, 2)).tolist() + [[1000 + i, 1001 + i] for i in range(70)] + [[2000 + i, 2099] for i in range(40)] + [[3000, 3000], [3001, 3001], [3001, 3002]]
    settled, settle = [], gr.settle

    def noted(df):
        out = settle(df)
        if set(out.columns) == {"a", "b"}:
            settled.append(out.count())
        return out

    monkeypatch.setattr(gr, "settle", noted)
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for x, y in pairs:
        x, y = sorted((find(x), find(y)))
        root[y] = x
    got = gr.components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((n, find(n)) for n in root)
    assert len(settled) > 1 and settled[1] < settled[0] / 2 and settled[-1] == 0


def test_neighbours_stay_with_their_destination(spark):
    """Faces and then pairs are shuffled once each; the smoothing rounds shuffle nodes, not pairs."""
    d = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 8), (2, 9), (3, 9), (4, None), (4, 7), (5, 7), (5, 8)], "e long, f long")
    n = gr.face_neighbours(d, [], "f", ["e"])
    plan = n.sparkSession._jvm.PythonSQLUtils.explainString(n._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, n.collect())) == [(7, 8), (8, 7), (8, 9), (9, 8)]


def test_ids_of_faces_are_not_read_from_other_lines(spark):
    """A join on corners must not read every vertex line as ids, whose failing casts cost most of the time."""
    d = spark.createDataFrame([(1, "v 1.5 2 3\nv 2 2 3\nv 3 2 3\nf 1/1 2/1 -1/1\nf 1 2\nv 4 0 0\nf -4 -3 -2 -1")], "mesh long, text string")
    f = rd.parse_mesh_text(d, ["mesh"], "text")[1].where("v0 IS NOT NULL AND v1 IS NOT NULL")
    plan = f.sparkSession._jvm.PythonSQLUtils.explainString(f._jdf.queryExecution(), "simple")
    assert not [x for x in plan.splitlines() if "Filter" in x and "transform(" in x]
    assert sorted((r.line, r.part, r.v0, r.v1, r.v2) for r in f.collect()) == [(3, 0, 0, 1, 2), (6, 0, 0, 1, 2), (6, 1, 0, 2, 3)]


def test_pairs_are_compared_where_they_meet(spark):
    """Pairs of views with short and with long lists of tokens as by brute force; short lists are compared in the join."""
    rng = np.random.default_rng(3)
    size = [2, 3, 5, jn.SHORT, jn.SHORT + 1, 40]
    sets = {v: set(rng.choice(90, size[v % len(size)], replace=False).tolist()) for v in range(90)}
    turn = {v: float(rng.uniform(0, np.pi)) for v in sets}
    views = spark.createDataFrame([("a", v, [float(np.cos(x)), float(np.sin(x)), 0.0]) for v, x in turn.items()], "k string, v long, d array<double>")
    tokens = spark.createDataFrame([("a", v, int(x)) for v, s in sets.items() for x in s], "k string, v long, t long")
    out = jn.view_pairs(views, tokens, ["k"], "v", "d", "t", 8.0, 2)
    plan = out.sparkSession._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert [x for x in plan.splitlines() if "Join" in x and "array_intersect" in x]
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2 and abs(turn[a] - turn[b]) * 180 / np.pi >= 8}
    assert {(r.view_a, r.view_b, r.shared) for r in out.collect()} == want


def test_draws_are_kept_without_their_keys(spark, monkeypatch):
    """What is settled of the draws holds no hash of each, and is read once."""
    kept, settle = [], md.settle
    monkeypatch.setattr(md, "settle", lambda df: kept.append(df.columns) or settle(df))
    d = spark.range(60).select((F.col("id") % 3).alias("k"), "id", F.lit(0.5).alias("q"), (F.col("id") / 60).alias("a"), (F.col("id") % 7 / 7).alias("d"), F.lit(False).alias("r"))
    out = md.subset_agreement(d, ["k"], "id", "q", "a", ["d"], "r", lambda c: c.withColumn("predicted", F.lit("one"))).collect()
    assert {(r.k, r.predicted, r.agreement) for r in out} == {(k, "one", 1.0) for k in range(3)}
    assert any("_trial" in c for c in kept) and not any("_key" in c for c in kept)


def test_job_state_asks_the_store_once_a_batch():
    """A new job's events need no look-ups, copies in a batch none either; a later batch finds ids and stages again."""
    calls = []

    class Values(dict):
        def exists(self): return "v" in self  # noqa: E704
        def get(self): return self["v"]  # noqa: E704
        def update(self, v): self["v"] = v  # noqa: E704

    class Map(Values):
        def containsKey(self, k): calls.append(("has", k)); return k in self  # noqa: E702, E704
        def getValue(self, k): calls.append(("get", k)); return self[k]  # noqa: E702, E704
        def updateValue(self, k, v): calls.append(("put", k)); self[k] = v  # noqa: E702, E704
        def removeKey(self, k): del self[k]  # noqa: E704
        def iterator(self): return iter(list(self.items()))  # noqa: E704

    class Handle:
        def getValueState(self, *a): return Values()  # noqa: E704
        def getMapState(self, *a): return Map()  # noqa: E704
        def registerTimer(self, at): pass  # noqa: E704

    p = st._job_state(["s"], None, 1000)
    p.init(Handle())
    frame = lambda *rows: pd.DataFrame(rows, columns=["us", "event", "kind", "stage", "keys", "digests"])
    rows = [(i, f"e{i}", "started" if i == 0 else "completed", "s", [f"k{i % 2}"], [str(i)]) for i in range(10)]
    out = next(iter(p.handleInputRows(("j",), [frame(*rows, *rows)], None)))
    assert (out["events"][0], out["attempts"][0], out["artifacts"][0]) == (10, [1], ["k0=8", "k1=9"])
    assert sorted(c[0] for c in calls) == ["put"] * (10 + 1 + 2)
    out = next(iter(p.handleInputRows(("j",), [frame(rows[3], (20, "e20", "started", "s", [], []))], None)))
    assert (out["events"][0], out["attempts"][0], out["artifacts"][0], out["status"][0]) == (11, [2], [], "running")


def _joins(df, *kinds):
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return [x.strip() for x in plan.splitlines() if any(k in x for k in kinds)]


def test_a_hot_group_is_never_shuffled_by_its_key_alone(spark):
    """Joins of a hot group's rows with its own few sums do not bring the group into one task, however small the tables
    that are broadcast unasked."""
    d = spark.range(0, 6000, 1, 4).select(F.lit("a").alias("k"), F.col("id"), F.pmod(F.hash("id"), F.lit(5000)).cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = gp.Split(["k"], 500)
        made = [split.rank(d, ["id"]), split.attach(d, n=F.count("*")), split.running(d, ["id"], s=F.col("v")), split.carry(d, ["id"], c=F.col("v")), split.attach_quantiles(d, m=(F.col("v"), 0.5))]
        assert not [x for m in made for x in _joins(m, "SortMergeJoin", "ShuffledHashJoin")]
        spark.conf.set("spark.clipledger.hotGroupRows", "500")
        got = ag.robust_scale(d, ["k"], F.col("v"))
        spark.conf.unset("spark.clipledger.hotGroupRows")
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in ag.robust_scale(d, ["k"], F.col("v")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.clipledger.hotGroupRows")


def test_edges_of_the_graph_are_shuffled_once_for_the_tasks_named(spark):
    """No hash table of all edges, and no few tasks that take what is packed small."""
    class t:
        lineitem = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 5), (3, 7)], "l_orderkey long, l_partkey long")
        orders = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "o_orderkey long, o_custkey long")

    edges = pg.customer_part(t)
    assert not _joins(edges, "HashAggregate") and _joins(edges, "REPARTITION_BY_NUM")
    assert {tuple(r) for r in edges.collect()} == {(c, p + pg.PARTS) for c, p in ((10, 5), (10, 6), (11, 5), (12, 7))}


def test_only_tokens_of_many_views_are_copied(spark, monkeypatch):
    """Rows of a join are copied for tokens that many views hold, not for all; pairs as by brute force."""
    rng = np.random.default_rng(3)
    rows = sorted({(v, int(t)) for v in range(120) for t in rng.choice(60, 5, p=np.arange(60, 0, -1) / 1830)})
    tokens = spark.createDataFrame([("g", v, t) for v, t in rows], "g string, v long, t long")
    views = spark.createDataFrame([("g", v, [float(np.cos(v)), float(np.sin(v)), 0.0]) for v in range(120)], "g string, v long, d array<double>")
    of = {v: {t for x, t in rows if x == v} for v in range(120)}
    made, join = [], jn.join_same

    def noted(left, right, by, how="inner"):
        if "_s" in by:
            made.append(right.count() / left.count())
        return join(left, right, by, how)

    monkeypatch.setattr(jn, "join_same", noted)
    for hot, low, high in ((1024, 1, 1), (12, 1.01, 3.99), (0, 4, 4)):
        monkeypatch.setattr(jn, "HOT", hot)
        got = jn.view_pairs(views, tokens, ["g"], "v", "d", "t", 0.0, 2).collect()
        assert {(r.view_a, r.view_b): r.shared for r in got} == {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b and len(of[a] & of[b]) >= 2}
        assert low <= made.pop() <= high


def test_a_view_is_fitted_and_measured_where_it_meets(spark):
    """One shuffle of the rows, no join and no aggregate of values; results as by a pass for each measure, also with
    nulls and values that are no numbers, and with a group beyond the limit for hot ones."""
    rng, odd, rows = np.random.default_rng(8), [None, float("nan"), 0.0, -1.0, float("inf")], []
    for v in range(60):
        for _ in range(int(rng.integers(1, 40)) if v else 400):
            p, z, w = float(rng.random()), float(rng.random() * 4), float(rng.integers(1, 6))
            p, z, w = (odd[int(rng.integers(5))] if v % 3 == 2 and rng.random() < 0.08 else x for x in (0.5 if v % 7 == 6 else p, 1 / (0.4 * p + 0.3) + z / 50 if v % 5 else z, w))
            rows.append((None if v == 59 else v % 30, f"s{v}", p, z, w, [None, "evaluation", "calibration", "calibration"][int(rng.integers(1 if v % 4 else 0, 4))], None if v == 57 else 8.0))
    o = spark.createDataFrame(rows, "a long, b string, p double, z double, w double, r string, s double")
    names = dict(prediction="p", z="z", weight="w", role="r", scale="s", rounds=2, limits={"calibration": 5, "held_out": 2})

    def of(d):
        return {(r.a, r.b): [round(x, 8) if isinstance(x, float) and x == x else str(x) for x in r] for r in d.select("a", "b", *sorted(c for c in d.columns if c not in "ab")).collect()}

    want = of(fits.evaluate_alignment(o, ["a", "b"], dense=o.select("*"), **names))
    whole = fits.evaluate_alignment(o, ["a", "b"], dense=o, **names)
    assert len(want) == 60 and of(whole) == want and not _joins(whole, "Join") and not _joins(whole, "ObjectHashAggregate") and _joins(whole, "MapInArrow")
    spark.conf.set("spark.clipledger.hotGroupRows", "300")
    try:
        assert of(fits.evaluate_alignment(o, ["a", "b"], dense=o, **names)) == want
    finally:
        spark.conf.unset("spark.clipledger.hotGroupRows")


def test_lines_of_meshes_are_counted_as_they_pass(spark, tmp_path):
    """Blocks of several files, some without a vertex, packed into few tasks: ids as by one pass over each file, without
    a window over lines."""
    rng, want = np.random.default_rng(2), {}
    for k in range(7):
        lines, n = [], 0
        for at in range(int(rng.integers(1, 900))):
            kind = "# x" if (at // 150) % 2 and k % 2 else ["v", "v", "v", "f", "", "# y"][int(rng.integers(6))]
            if kind == "v":
                lines.append(f"v {n} {k} 0")
                n += 1
            elif kind == "f" and n > 4:
                lines.append("f -1 -2 -3" if rng.random() < 0.5 else f"f {n}/1 {n - 1} {n - 2}//7")
                want.setdefault(k, [[], 0])[0].append((len(lines) - 1, n - 1, n - 2, n - 3))
            else:
                lines.append(kind if kind != "f" else "")
        want.setdefault(k, [[], 0])[1] = n
        (tmp_path / f"m{k}.obj").write_text("\n".join(lines) + "\n")
    for most in ("700", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            vertices, faces = rd.read_mesh_text(spark, str(tmp_path))
            assert not [x for d in (vertices, faces) for x in _joins(d, "Window ") if "_lines" not in x and "_own" not in x]
            for k, (triangles, n) in want.items():
                name = f"/m{k}.obj"
                assert sorted((v.vid, v.x, v.y) for v in vertices.where(F.col("mesh").endswith(name)).collect()) == [(i, float(i), float(k)) for i in range(n)]
                assert sorted((f.line, f.v0, f.v1, f.v2) for f in faces.where(F.col("mesh").endswith(name)).collect()) == triangles
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_orders_are_written_as_meshes_by_the_tasks_that_gather_them(spark, tmp_path, monkeypatch):
    """No second shuffle into a fixed number of files."""
    plans, write = [], catalog.text_files
    monkeypatch.setattr(catalog, "text_files", lambda rows, *parts: plans.append(_joins(rows, "REPARTITION", "rangepartitioning")) or write(rows, *parts))
    spark.createDataFrame([(o, float(q), 10.0 * q) for o in range(1, 30) for q in range(o % 6 + 1)], "l_orderkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_orderkey: r.triangles for r in QUERIES["mesh_files"](spark, str(tmp_path)).collect()}
    assert plans == [[]] and got == {o: o % 6 - 1 for o in range(1, 30) if o % 6 >= 2}


def test_neighbours_need_one_sort_and_no_aggregate_of_faces(spark):
    """Sets of faces come from the sorted rows; repeated rows, null faces and null edges as by brute force."""
    rng = np.random.default_rng(9)
    rows = [(None if e == 49 else int(e), None if f == 39 else int(f)) for e, f in rng.integers(0, [50, 40], (300, 2))]
    found = gr.face_neighbours(spark.createDataFrame(rows * 2, "e long, f long"), [], "f", ["e"])
    assert not _joins(found, "ObjectHashAggregate", "SortAggregate", "WindowGroupLimit") and len(_joins(found, "Exchange")) == 2
    of = {e: {f for x, f in rows if x == e and f is not None} for e, _ in rows}
    assert sorted((r.src, r.dst) for r in found.collect()) == sorted({(a, b) for s in of.values() for a in s for b in s if a != b})
