"""Top-k, best-of, and greedy selections. Greedy picks run as rounds: each round one group aggregate finds the next
pick and every row updates its distance to it, so a group never has to be gathered in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import arrays, geometry as geo
from clipledger.operators.groups import by_group, top_k  # noqa: F401
from clipledger.operators.pairs import pair_quantile
from clipledger.session import join_same, settle

ROUNDS_PER_CUT = 8


def best_evidence(df: DataFrame, by: Sequence[str], kind: str, confidence: str, minimum: float, keep: Sequence[str]) -> DataFrame:
    """Strongest row per (group, kind) above a confidence floor."""
    d = df.where(F.col(confidence) >= minimum)
    if not keep:
        return d.groupBy(*by, kind).agg(F.max(confidence).alias(confidence))
    best = F.max_by(F.struct(confidence, *keep), F.struct(confidence, *keep))
    return d.groupBy(*by, kind).agg(best.alias("_b")).select(*by, kind, "_b.*")


def best_by(df: DataFrame, by: Sequence[str], key: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Row with the lexicographically greatest key per group."""
    best = F.max_by(F.struct(*keep), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def _greedy(d: DataFrame, g, rounds: int, target: Column, key, payload: list[Column], update, rank: str = "selection_rank") -> DataFrame:
    """Run greedy rounds. ``key(first)`` orders candidates (greatest wins, null = not eligible), ``payload`` travels
    with the pick, ``update(pick)`` gives the new state columns of every row. Rows are told apart by ``_i``."""
    d = d.withColumn(rank, F.lit(None).cast("int"))
    for r in range(rounds):
        open_ = F.col(rank).isNull() & (F.lit(r) < target)
        pick = F.max_by(F.struct(F.col("_i"), *payload), F.when(open_, key(r == 0)))
        d = g.attach(d, _pick=pick)
        d = d.withColumn(rank, F.when(F.col("_pick._i") == F.col("_i"), F.lit(r)).otherwise(F.col(rank)))
        d = d.withColumns(update(F.col("_pick"))).drop("_pick")
        if (r + 1) % ROUNDS_PER_CUT == 0 and r + 1 < rounds:
            d = g.fix(d)
    return d.where(F.col(rank).isNotNull())


def select_keyframes(frames: DataFrame, by: Sequence[str], order: Sequence[str], time: str, quality: str, vector: str, count: int, min_gap: float,
                     penalised: Column | None = None) -> DataFrame:
    """Diverse keyframes: best quality first, then .58·quality + .27·novelty + .15·time spread, keeping ``min_gap``
    seconds apart while that is possible. Adds ``selection_rank``."""
    by = list(by)
    frames = settle(frames)  # read several times below
    scale = pair_quantile(frames, by, vector, order, 0.9, "_novel")
    d = join_same(frames, scale, by, "left").withColumn("_pen", F.lit(0.0) if penalised is None else F.when(penalised, 0.35).otherwise(0.0))

    def step(d, g):
        d = g.attach(g.rank(d, order, "_i"), _n=F.count("*"), _t0=F.min(time), _t1=F.max(time))
        target = F.least(F.lit(count), F.col("_n"))
        spread = F.greatest((F.col("_t1") - F.col("_t0")) / F.greatest(F.lit(1), target - 1), F.lit(float(min_gap)), F.lit(1e-6))
        d = d.withColumn("_ts", spread).withColumn("_ds", F.greatest(F.coalesce("_novel", F.lit(1.0)), F.lit(1e-6)))
        d = d.withColumn("_dt", F.lit(None).cast("double")).withColumn("_dv", F.lit(None).cast("double"))

        def key(first):
            if first:
                return F.struct(F.lit(1).alias("ok"), F.col(quality).alias("u"), (-F.col("_i")).alias("o"))
            u = 0.58 * F.col(quality) + 0.27 * F.least(F.lit(1.0), F.col("_dv") / F.col("_ds")) + 0.15 * F.least(F.lit(1.0), F.col("_dt") / F.col("_ts")) - F.col("_pen")
            ok = (F.col("_dt") + 1e-9 >= min_gap).cast("int")
            return F.struct(ok.alias("ok"), F.round(u, 12).alias("u"), (-F.col("_i")).alias("o"))

        def update(p):
            return {"_dt": F.least(F.col("_dt"), F.abs(F.col(time) - p["t"])), "_dv": F.least(F.col("_dv"), arrays.mean_abs_diff(vector, p["v"]))}

        payload = [F.col(time).alias("t"), F.col(vector).alias("v")]
        out = _greedy(d, g, count, target, key, payload, update)
        return out.drop("_i", "_n", "_t0", "_t1", "_ts", "_ds", "_dt", "_dv", "_pen", "_novel")

    return by_group(d, by, step)


def select_coverage(poses: DataFrame, by: Sequence[str], order: Sequence[str], azimuth: str, corners: str, rms: str, count: int, min_gap: float = 12.0) -> DataFrame:
    """Poses spread around a circle: best supported first, then the one farthest from all picks. A gap of
    ``min_gap`` degrees is preferred and relaxed only when nothing satisfies it. Rows without a pose are ignored."""

    def step(d, g):
        d = g.attach(g.rank(d, order, "_i"), _n=F.count("*")).withColumn("_d", F.lit(None).cast("double"))

        def key(first):
            support = [F.col(corners).alias("c"), (-F.col(rms)).alias("r"), (-F.col("_i")).alias("o")]
            if first:
                return F.struct(F.lit(1).alias("ok"), F.lit(0.0).alias("d"), *support)
            return F.struct((F.col("_d") >= min_gap).cast("int").alias("ok"), F.round("_d", 12).alias("d"), *support)

        def update(p):
            return {"_d": F.least(F.col("_d"), geo.circular_distance(F.col(azimuth), p["a"]))}

        return _greedy(d, g, count, F.col("_n"), key, [F.col(azimuth).alias("a")], update).drop("_i", "_n", "_d")

    return by_group(poses.where(F.col(azimuth).isNotNull()), by, step)


def farthest_point(df: DataFrame, by: Sequence[str], name: str, vector: str, count: int) -> DataFrame:
    """Angular farthest-point sample of unit vectors: first name, then the largest minimum angle, ties by name."""

    def step(d, g):
        d = g.rank(d, [name], "_i").withColumn("_d", F.lit(None).cast("double"))

        def key(first):
            return F.struct((F.lit(0.0) if first else F.round("_d", 9)).alias("d"), (-F.col("_i")).alias("o"))

        def update(p):
            return {"_d": F.least(F.col("_d"), F.radians(arrays.ordered_unit_angle(vector, p["v"])))}

        return _greedy(d, g, count, F.lit(count), key, [F.col(vector).alias("v")], update).drop("_i", "_d")

    return by_group(df, by, step)


def separated_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], vector: str, degrees: float = 18.0) -> DataFrame:
    """Rows kept by walking in order and keeping a direction only if it is ``degrees`` away from all kept ones.

    Each round keeps the first uncovered row of every group and covers its surroundings; covered rows are dropped
    at every lineage cut, so the work shrinks until nothing is left.
    """
    limit = F.cos(F.radians(F.lit(float(degrees))))

    def step(d, g):
        rest = g.rank(d, order, "_i").withColumn("_kept", F.lit(False)).withColumn("_near", F.lit(False))
        done = None
        while True:
            for _ in range(ROUNDS_PER_CUT):
                pick = F.min_by(F.struct(F.col("_i"), F.col(vector).alias("v")), F.when(~F.col("_near"), F.col("_i")))
                rest = g.attach(rest, _p=pick)
                near = F.coalesce(arrays.dot(vector, F.col("_p.v")) >= limit, F.lit(False)) | F.coalesce(F.col("_p._i") == F.col("_i"), F.lit(False))
                rest = rest.withColumn("_kept", F.col("_kept") | F.coalesce(F.col("_p._i") == F.col("_i"), F.lit(False)))
                rest = rest.withColumn("_near", F.col("_near") | near).drop("_p")
            rest = settle(rest)
            kept = rest.where("_kept")
            done = kept if done is None else settle(done.unionByName(kept))
            rest = rest.where("NOT _near")
            if rest.isEmpty():
                return done.drop("_i", "_kept", "_near")

    return by_group(df, by, step)


def balanced_pairs(pairs: DataFrame, by: Sequence[str], bin_col: str, angle: str, middle: Column, a: str, b: str, cap: int = 24) -> DataFrame:
    """Round-robin over bins: each bin in turn gives the pair with most unused ends, then nearest to the bin middle,
    then by name, until ``cap`` pairs are chosen. Adds ``pick``."""

    def step(d, g):
        d = d.withColumn("_off", F.round(F.abs(F.col(angle) - middle), 9)).withColumn("_last", F.lit(-1))
        d = d.withColumn("_ua", F.lit(0)).withColumn("_ub", F.lit(0)).withColumn("pick", F.lit(None).cast("int"))
        for r in range(cap):
            wrapped = (F.col(bin_col) <= F.col("_last")).cast("int")
            key = F.struct(wrapped.alias("w"), F.col(bin_col).alias("bin"), (F.col("_ua") + F.col("_ub")).alias("u"), F.col("_off").alias("off"), F.col(a).alias("a"), F.col(b).alias("b"))
            d = g.attach(d, _p=F.min(F.when(F.col("pick").isNull(), key)))
            p = F.col("_p")
            hit = (p["a"] == F.col(a)) & (p["b"] == F.col(b)) & (p["bin"] == F.col(bin_col)) & F.col("pick").isNull()
            d = d.withColumns({
                "pick": F.when(hit, F.lit(r)).otherwise(F.col("pick")),
                "_last": F.coalesce(p["bin"], F.col("_last")),
                "_ua": F.when((F.col(a) == p["a"]) | (F.col(a) == p["b"]), 1).otherwise(F.col("_ua")),
                "_ub": F.when((F.col(b) == p["a"]) | (F.col(b) == p["b"]), 1).otherwise(F.col("_ub")),
            }).drop("_p")
            if (r + 1) % ROUNDS_PER_CUT == 0 and r + 1 < cap:
                d = g.fix(d)
        return d.where("pick IS NOT NULL").drop("_off", "_last", "_ua", "_ub")

    return by_group(settle(pairs), by, step)


def select_candidate(candidates: DataFrame, by: Sequence[str], name: str, priority: Column, usable: Column, reason: Column) -> DataFrame:
    """First usable candidate in priority order, else ``needs_recapture`` with all distinct reasons in that order."""
    by = list(by)
    d = candidates.withColumn("_p", priority).withColumn("_ok", F.coalesce(usable, F.lit(False))).withColumn("_why", reason)
    best = d.groupBy(*by).agg(F.min_by(name, F.when(F.col("_ok"), F.struct("_p", name))).alias("_best"))
    # reasons are codes: merged first, so that each group holds at most one entry per (priority, code)
    why = d.where("NOT _ok AND _why IS NOT NULL").groupBy(*by, "_p", "_why").agg(F.lit(1).alias("_one"))
    why = why.groupBy(*by).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_why"))), lambda s: s["_why"])).alias("_reasons"))
    out = join_same(best, why, by, "left")
    none = F.col("_best").isNull()
    return out.select(
        *by, F.coalesce("_best", F.lit("needs_recapture")).alias("selected"),
        F.when(none, F.coalesce("_reasons", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("reasons"))


def device_time(index: Column, device: Column, fps: Column) -> Column:
    """Device time, unless it is stale (below half of index/fps)."""
    steady = index / fps
    return F.when(device >= steady * 0.5, device).otherwise(steady)


def sample_cadence(frames: DataFrame, by: Sequence[str], time: str, order: Sequence[str], sample_fps: float, source_fps: float | Column, max_n: int, duration: Column) -> DataFrame:
    """Frames emitted at a fixed cadence: a frame is taken when its time plus half a source frame reaches the next
    grid point, which then moves past it. At most ``max_n`` frames per clip. ``source_fps`` is one rate or the clip's
    own. Where half a source frame spans a grid interval or more, every frame is taken. Adds ``candidate_index``.

    On a grid of one interval per cell, a cell emits its first frame, unless an early frame of the cell before used
    up its slot, and the first other frame close enough to the next grid point. So a cell needs only to know whether
    its slot is used, and each cell either decides that for the next one or hands it on: one carried value replaces
    the frame-by-frame state.
    """
    by = list(by)
    half = 0.5 / (F.lit(float(source_fps)) if isinstance(source_fps, (int, float)) else source_fps)
    rate = F.least(F.lit(float(sample_fps)), max_n / F.greatest(F.col("_dur"), F.lit(1e-6)))
    d = frames.withColumn("_half", half).withColumn("_dur", duration).withColumn("_step", 1 / rate).withColumn("_cell", F.floor(F.col(time) / F.col("_step")))
    late = F.col(time) + F.col("_half") >= (F.col("_cell") + 1) * F.col("_step")
    d = d.withColumn("_me", F.struct(time, *order)).withColumn("_late", late)
    every = d.where("_half >= _step").select(*by, time, *order)
    d = d.where("_half < _step")
    cells = d.groupBy(*by, "_cell").agg(F.min("_me").alias("_first"), F.min(F.when(F.col("_late"), F.col("_me"))).alias("_early"))
    rest = join_same(d.where("_late").select(*by, "_cell", "_me"), cells.select(*by, "_cell", "_first"), by + ["_cell"])
    other = rest.where("_me != _first").groupBy(*by, "_cell").agg(F.min("_me").alias("_other"))
    cells = join_same(cells, other, by + ["_cell"], "left")

    def step(c, g):
        c = g.slide(c, ["_cell"], 1, 0, _start=lambda w: F.coalesce(F.lag("_cell").over(w) != F.col("_cell") - 1, F.lit(True)))
        gives = F.when(F.col("_other").isNotNull(), True).when(F.col("_early").isNull() | F.col("_start"), False)
        c = g.carry(c, ["_cell"], _gives=gives)
        return g.slide(c, ["_cell"], 1, 0, _used=lambda w: ~F.col("_start") & F.coalesce(F.lag("_gives").over(w), F.lit(False)))

    cells = by_group(cells, by, step)
    taken = F.when(F.col("_used"), F.array("_early")).otherwise(F.array("_first", "_other"))
    emitted = cells.select(*by, F.explode(F.filter(taken, lambda x: x.isNotNull())).alias("_e")).select(*by, "_e.*")
    emitted = emitted.unionByName(every)
    return top_k(emitted, by, [time, *order], max_n, "_rn").withColumn("candidate_index", F.col("_rn") - 1).drop("_rn")
