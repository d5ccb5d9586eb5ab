"""Iterative operators on edge tables. Each round joins on keys and combines partial minima or sums, so a node with a
large share of the edges never has to be gathered; lineage is cut with a checkpoint per round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.functions import arrays, geometry as geo
from clipledger.functions.rules import Rule, apply_gates
from clipledger.operators.aggregates import quantiles
from clipledger.operators.pairs import aligned_quantile, pair_quantile
from clipledger.operators.selection import best_by
from clipledger.operators.windows import stable_run, unwrap
from clipledger.session import join_same, settle, spread_groups


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge table (src, dst): node → smallest node of its component.

    Each node with a smaller neighbour goes into the smallest one; such steps are followed to their end, and the edges
    between what is left are the next round's. A node that stays either takes up a neighbour or gets a smaller one, so
    two rounds halve the nodes at least, and every round works on the edges that are left, not on all of them.
    """
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    e = settle(edges.select(a.alias("a"), b.alias("b")))
    loops = e.where("a = b").select(F.col("a").alias("node"))
    e, taken = e.where("a < b"), []
    while True:
        up = settle(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        if up.isEmpty():
            break
        up = _to_the_end(up)
        taken.append(up)
        low = e.join(up.select(F.col("node").alias("b"), F.col("up").alias("_b")), "b")
        low = low.join(up.select(F.col("node").alias("a"), F.col("up").alias("_a")), "a", "left").withColumn("_a", F.coalesce("_a", "a")).where("_a != _b")
        e = settle(low.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if not taken:
        return loops.distinct().select("node", F.col("node").alias("component"))
    lab = taken.pop()
    while taken:  # a node of an earlier round has the label of the one that took it up
        of = lab.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        lab = taken.pop().join(of, "up", "left").select("node", F.coalesce("_up", "up").alias("up")).unionByName(lab)
    lab = settle(lab)
    own = lab.select("up").distinct().select(F.col("up").alias("node"), F.col("up").alias("component"))
    lab = lab.withColumnRenamed("up", "component").unionByName(own)
    alone = loops.distinct().join(lab, "node", "left_anti")
    return lab.unionByName(alone.select("node", F.col("node").alias("component")))


def _to_the_end(up: DataFrame) -> DataFrame:
    """Steps to a smaller node (node, up), followed to their end: each round doubles their reach."""
    while True:
        on = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("_on")), "up", "left")
        if on.where("_on IS NOT NULL").isEmpty():
            return up
        up = settle(on.select("node", F.coalesce("_on", "up").alias("up")))


def component_stats(labels: DataFrame) -> DataFrame:
    """Size of each component, its share of all nodes and whether it is the largest (ties: smallest label)."""
    s = labels.groupBy("component").agg(F.count("*").alias("size"))
    total = s.agg(F.sum("size")).scalar()
    best = s.agg(F.min(F.struct(-F.col("size"), "component")).getField("component")).scalar()
    return s.withColumn("dominance", F.col("size") / total).withColumn("largest", F.col("component") == best)


def charts(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of equally labelled neighbours. ``labels`` has node and label; nodes without such a neighbour are
    their own chart."""
    l = labels.select("node", "label")
    e = edges.join(l.withColumnRenamed("node", "src").withColumnRenamed("label", "_ls"), "src").join(l.withColumnRenamed("node", "dst").withColumnRenamed("label", "_ld"), "dst")
    same = e.where("_ls = _ld").select("src", "dst")
    c = components(same)
    return l.join(c, "node", "left").select("node", "label", F.coalesce("component", "node").alias("chart"))


def nearest_labelled(edges: DataFrame, seeds: DataFrame, labelled: DataFrame) -> DataFrame:
    """Breadth-first search from all seeds at once: the labelled nodes of the first level that has any."""
    e = settle(_both_ways(edges))
    seen = settle(seeds.select("node").distinct())
    front, level = seen, 0
    while True:
        level += 1
        reach = e.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = settle(reach.join(seen, "node", "left_anti"))
        if new.isEmpty():
            return new.withColumn("level", F.lit(level))
        found = new.join(labelled.select("node"), "node", "left_semi")
        if not found.isEmpty():
            return found.withColumn("level", F.lit(level))
        seen, front = settle(seen.unionByName(new)), new


def face_neighbours(faces: DataFrame, by: Sequence[str], face: str, edge: Sequence[str], most: int = 64) -> DataFrame:
    """Neighbouring faces over shared edges, given (face, edge) rows: every two faces of an edge, in both directions.

    Meshes have two faces on an edge, sometimes some more. An edge with more than ``most`` faces ends the query with an
    error, since its pairs would grow with their square; none is left out in silence.
    """
    by, edge = list(by), list(edge)
    all_ = Window.partitionBy(*by, *edge)  # one shuffle and one sort of the rows, for both windows
    f = faces.select(*by, *edge, face).where(F.col(face).isNotNull()).withColumn("_r", F.dense_rank().over(all_.orderBy(face)))
    f = f.withColumn("_f", F.collect_set(F.when(F.col("_r") <= most + 1, F.col(face))).over(all_))
    said = F.concat(F.lit(f"more than {most} faces on the edge "), F.to_json(F.struct(*by, *edge)))
    few = f.where(F.when(F.size("_f") <= most, F.size("_f") > 1).otherwise(F.raise_error(said).cast("boolean")))
    pairs = few.select(*by, F.col(face).alias("src"), F.explode("_f").alias("dst")).where("src != dst")
    return spread_groups(pairs, [*by, "dst"]).distinct()  # rows of a dst stay together: joins on it need no shuffle


def smooth_labels(scores: DataFrame, neighbours: DataFrame, weight: float = 0.12, rounds: int = 2) -> DataFrame:
    """Labels by score plus ``weight`` × share of neighbours with that label, all nodes updated at once.

    ``scores``: node, label, score (valid labels only). ``neighbours``: src, dst in both directions. Ties go to the
    lowest label.
    """
    lab = scores.groupBy("node").agg(F.min(F.struct(-F.col("score"), "label")).alias("_b")).select("node", "_b.label")
    neighbours = neighbours.select("src", "dst").persist(StorageLevel.DISK_ONLY)
    degree = neighbours.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_deg"))
    base = settle(scores.join(degree, "node", "left"))
    for _ in range(max(rounds, 0)):
        lab = settle(lab)
        votes = neighbours.join(lab.withColumnRenamed("node", "dst").hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count("*").alias("_k"))
        s = base.join(votes, ["node", "label"], "left")
        total = F.round(F.col("score") + F.coalesce(weight * F.col("_k") / F.col("_deg"), F.lit(0.0)), 9)
        lab = s.groupBy("node").agg(F.min(F.struct(-total, "label")).alias("_b")).select("node", "_b.label")
    lab = settle(lab)
    neighbours.unpersist()
    return lab


def smooth_in_order(scores: DataFrame, neighbours: DataFrame, weight: float | None = None, sweeps: int = 3) -> DataFrame:
    """Labels of least cost, nodes visited one after another in ascending order: a node takes the label for which
    ``weight`` times its neighbours with another label, less the score, is least (ties: the lowest label). A node sees
    what its lower neighbours got in this sweep and what its higher ones had before. ``weight``: 0.15 times the median
    of the nodes' best scores by default.

    A sweep is found without walking the nodes: starting from the labels before, all nodes whose lower neighbours have
    changed are decided anew, until nothing changes. As a node depends on lower ones alone, that end is the sweep's
    exact result, and it takes as many steps as changes follow one another along rising nodes, which are few.
    """
    best = lambda cost: F.min(F.struct(cost.alias("c"), "label")).alias("_b")
    scores = settle(scores.select("node", "label", F.col("score").cast("double").alias("score")))
    first = scores.groupBy("node").agg(best(-F.col("score")))
    if weight is None:
        found = quantiles(first.select(F.lit(0).alias("_g"), (-F.col("_b.c")).alias("_s")), ["_g"], _m=(F.col("_s"), 0.5)).select("_m").first()
        weight = 0.15 * (found[0] if found else 0.0)
    lab = settle(first.select("node", "_b.label"))
    if weight <= 0:
        return lab
    near = neighbours.select(F.col("src").alias("node"), "dst").distinct()
    degree = near.groupBy("node").agg(F.count("*").alias("_deg"))
    base = settle(scores.join(degree, "node", "left").withColumn("_deg", F.coalesce("_deg", F.lit(0))))
    near = settle(near)

    def decide(now: DataFrame, due: DataFrame | None) -> DataFrame:
        """Labels of all nodes, or of those due, by what their neighbours have (``label``) and had (``old``)."""
        some = near if due is None else near.join(due, "node", "left_semi")
        seen = some.join(now.select(F.col("node").alias("dst"), "label", "old"), "dst")
        votes = seen.groupBy("node", F.when(F.col("dst") < F.col("node"), F.col("label")).otherwise(F.col("old")).alias("label")).agg(F.count("*").alias("_k"))
        cost = -F.col("score") + weight * (F.col("_deg") - F.coalesce("_k", F.lit(0))).cast("double")
        own = base if due is None else base.join(due, "node", "left_semi")
        return own.join(votes, ["node", "label"], "left").groupBy("node").agg(best(cost)).select("node", F.col("_b.label").alias("_new"))

    for _ in range(max(sweeps, 0)):
        now, due = lab.withColumn("old", F.col("label")), None
        while True:
            again = now.join(decide(now, due), "node", "left")
            moved = F.coalesce(F.col("_new") != F.col("label"), F.lit(False))
            now = settle(again.select("node", F.coalesce("_new", "label").alias("label"), "old", moved.alias("_moved")))
            changed = now.where("_moved").select(F.col("node").alias("dst"))
            if changed.isEmpty():
                break
            due = near.join(changed, "dst", "left_semi").where("dst < node").select("node").distinct()
            now = now.drop("_moved")
        lab = now.select("node", "label")
    return lab


def taubin(values: DataFrame, neighbours: DataFrame, coords: Sequence[str], lam: float = 0.45, mu: float = -0.47, rounds: int = 8) -> DataFrame:
    """Shrink-free smoothing: each round moves nodes towards their neighbours' mean by ``lam``, then by ``mu``."""
    coords = list(coords)
    nb = neighbours.select("src", "dst").persist(StorageLevel.DISK_ONLY)
    v = values.select("node", *coords)
    for step in [lam, mu] * rounds:
        v = settle(v)
        mean = nb.join(v.withColumnRenamed("node", "dst").hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.avg(c).alias(f"_m_{c}") for c in coords])
        v = v.join(mean, "node", "left").select("node", *[(F.col(c) + step * F.coalesce(F.col(f"_m_{c}") - F.col(c), F.lit(0.0))).alias(c) for c in coords])
    v = settle(v)
    nb.unpersist()
    return v


def level_offsets(edges: DataFrame, ridge: float = 0.1, tolerance: float = 1e-14) -> DataFrame:
    """Offsets g that minimise Σ w·(g_a − g_b − diff)² + Σ (ridge·g)² over edges (a, b, diff, w), by conjugate gradients.

    Every round is one join of the edges with the direction and two sums; only three numbers reach the driver. Rounds
    go on until the residual is small enough. Exact arithmetic needs one per node at most; rounding may add some, and
    after twice as many and 50 more the fit is given up with an error.
    """
    e = settle(edges.select("a", "b", F.col("diff").cast("double"), F.col("w").cast("double")))
    rhs = e.select(F.col("a").alias("node"), (F.col("w") * F.col("diff")).alias("r")).unionByName(e.select(F.col("b").alias("node"), (-F.col("w") * F.col("diff")).alias("r")))
    s = settle(rhs.groupBy("node").agg(F.sum("r").alias("r")).select("node", F.lit(0.0).alias("g"), "r", F.col("r").alias("p")))
    rr = s.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    start, rounds, most = rr, 0, 2 * s.count() + 50
    while rr > tolerance * start:
        rounds += 1
        if rounds > most:
            raise ArithmeticError(f"offsets did not settle in {most} rounds")
        p = s.select("node", "p")
        j = e.join(p.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(p.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        j = j.withColumn("t", F.col("w") * (F.col("pa") - F.col("pb")))
        ap = j.select(F.col("a").alias("node"), "t").unionByName(j.select(F.col("b").alias("node"), (-F.col("t")).alias("t"))).groupBy("node").agg(F.sum("t").alias("ap"))
        s = settle(s.join(ap, "node", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)) + ridge * ridge * F.col("p")))
        pap, rap, apap = s.agg(F.sum(F.col("p") * F.col("ap")), F.sum(F.col("r") * F.col("ap")), F.sum(F.col("ap") * F.col("ap"))).first()
        alpha = rr / pap
        new = max(rr - 2 * alpha * rap + alpha * alpha * apap, 0.0)
        r = F.col("r") - alpha * F.col("ap")
        s = s.select("node", (F.col("g") + alpha * F.col("p")).alias("g"), r.alias("r"), (r + new / rr * F.col("p")).alias("p"))
        rr = new
    return s.select("node", F.col("g").alias("offset"))


def prune(rows: DataFrame, by: Sequence[str], agree, minimum: float = 0.45, rounds: int = 3, needed: int = 10) -> DataFrame:
    """Drop rows that disagree with their group's consensus, recompute it, and repeat.

    ``agree(df)`` returns the rows with an ``agreement`` column measured against the current members. A group stops
    when nothing is dropped, when fewer than ``needed`` rows remain, or after ``rounds``; a group that starts with fewer
    is left as it is. ``accepted`` tells whether enough are left.
    """
    by = list(by)
    many = rows.groupBy(*by).agg((F.count("*") >= needed).alias("_open"))
    d = settle(join_same(rows, many, by))
    for _ in range(rounds):
        s = agree(d.where("_open")).withColumn("_drop", F.col("agreement") < minimum).drop("agreement")
        n = s.groupBy(*by).agg(F.count(F.when(~F.col("_drop"), 1)).alias("_left"), F.count(F.when(F.col("_drop"), 1)).alias("_gone"))
        s = join_same(s, n, by).where("NOT _drop").withColumn("_open", (F.col("_gone") > 0) & (F.col("_left") >= needed)).drop("_drop", "_left", "_gone")
        d = settle(s.unionByName(d.where("NOT _open")))
        if d.where("_open").isEmpty():
            break
    n = d.groupBy(*by).agg(F.count("*").alias("kept"))
    return join_same(d.drop("_open"), n, by).withColumn("accepted", F.col("kept") >= needed)


def orbit_fit(views: DataFrame, by: Sequence[str], order: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Cylindrical orbit coordinates about each group's centre: the plane normal is the direction of least spread.

    Adds azimuth (unwrapped along ``order``), elevation and radius in degrees and input units.
    """
    by = list(by)
    v = [F.col(c).cast("double") for c in (x, y, z)]
    m = views.groupBy(*by).agg(
        *[F.avg(c).alias(f"_c{i}") for i, c in enumerate(v)],
        *[F.covar_pop(v[i], v[j]).alias(f"_m{i}{j}") for i in range(3) for j in range(i, 3)])
    a, b, c, d, e, f = (F.col(n) for n in ("_m00", "_m11", "_m22", "_m01", "_m02", "_m12"))
    low = geo.symmetric_eigenvalues([a, b, c, d, e, f])[2]
    m = m.withColumn("_low", low)
    low = F.col("_low")
    rows = [[a - low, d, e], [d, b - low, f], [e, f, c - low]]
    # the normal is orthogonal to all rows of (M - λI): the longest cross product of two rows is used
    options = [geo.cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    sized = [F.struct((o[0] * o[0] + o[1] * o[1] + o[2] * o[2]).alias("s"), F.array(*o).alias("n")) for o in options]
    m = m.withColumn("_n", F.greatest(*sized)["n"])
    m = m.withColumn("_n", arrays.normalised("_n"))
    # orient towards positive on the largest axis, then take any in-plane basis
    sign = F.when(F.get("_n", arrays.argmax(F.transform("_n", lambda q: F.abs(q)))) < 0, -1.0).otherwise(1.0)
    m = m.withColumn("_sg", sign)
    n = [F.col("_n")[i] * F.col("_sg") for i in range(3)]
    helper = F.when(F.abs(n[0]) < 0.9, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    m = m.withColumn("_nn", F.array(*n)).withColumn("_h", helper)
    n = [F.col("_nn")[i] for i in range(3)]
    m = m.withColumn("_u", arrays.normalised(F.array(*geo.cross(n, [F.col("_h")[i] for i in range(3)]))))
    m = m.withColumn("_w", F.array(*geo.cross(n, [F.col("_u")[i] for i in range(3)])))
    j = join_same(views, m.select(*by, "_c0", "_c1", "_c2", "_nn", "_u", "_w"), by)
    rel = [v[i] - F.col(f"_c{i}") for i in range(3)]
    along = lambda c: sum((rel[i] * F.col(c)[i] for i in range(3)), F.lit(0.0))
    j = j.withColumns({"_pu": along("_u"), "_pw": along("_w"), "_pn": along("_nn")})
    j = j.withColumn("radius", F.sqrt(F.col("_pu") ** 2 + F.col("_pw") ** 2 + F.col("_pn") ** 2))
    j = j.withColumn("elevation", geo.elevation(F.col("_pu"), F.col("_pw"), F.col("_pn"))).withColumn("_az", geo.azimuth(F.col("_pu"), F.col("_pw")))
    j = j.drop("_c0", "_c1", "_c2", "_nn", "_u", "_w", "_pu", "_pw", "_pn")
    return unwrap(j, by, order, F.col("_az"), "azimuth").drop("_az")


def accept_completed(rows: DataFrame, by: Sequence[str], iou: str, registered: Column) -> DataFrame:
    """Keep completed rows whose overlap reaches max(0.50, 0.70 · median of the registered ones)."""
    med = quantiles(rows, by, _m=(F.when(registered, F.col(iou).cast("double")), 0.5))
    limit = F.greatest(F.lit(0.50), F.coalesce(0.70 * F.col("_m"), F.lit(0.0)))
    return join_same(rows, med, list(by)).withColumn("kept", registered | (F.col(iou) >= limit)).drop("_m")


def best_turn(silhouette: str, other: str, appearance: str, other_appearance: str, side: int) -> Column:
    """``struct(cost, silhouette, appearance, turn)``: the quarter turn of the other square mask, against the clock, in
    which the two silhouettes are nearest, with the distances of silhouettes and appearances."""
    looks = F.least(F.greatest(1 - arrays.dot(appearance, other_appearance), F.lit(0.0)), F.lit(2.0))
    y, x = lambda i: F.floor(i / side).cast("int"), lambda i: i % side
    source = [lambda i: i, lambda i: x(i) * side + (side - 1 - y(i)), lambda i: side * side - 1 - i, lambda i: (side - 1 - x(i)) * side + y(i)]
    turn = lambda at: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.get(F.col(other), at(i)))
    choices = []
    for k, at in enumerate(source):
        turned = turn(at)
        both = arrays.total(F.zip_with(F.col(silhouette), turned, lambda a, b: ((a > 0) & (b > 0)).cast("double")))
        either = arrays.total(F.zip_with(F.col(silhouette), turned, lambda a, b: ((a > 0) | (b > 0)).cast("double")))
        far = F.when(either > 0, 1 - both / either).otherwise(0.0)
        choices.append(F.struct((far + 0.15 * looks).alias("cost"), far.alias("silhouette"), looks.alias("appearance"), F.lit(k).alias("turn")))
    found = F.array_min(F.array(*choices))
    return F.when(F.col(silhouette).isNotNull() & F.col(other).isNotNull(), found)


def select_families(views: DataFrame, by: Sequence[str], time: str, order: Sequence[str], *, marking: str, aspect: Column, strict: Column, score: str, detail: str,
                    secondary: str, silhouette: str, appearance: str, gap, limits: dict | None = None, side: int | None = None) -> DataFrame:
    """Two supported appearance families and one view of each: marked (primary) and plain (secondary).

    Each family is its best temporal run; its silhouettes must agree; the picked views must look different enough.
    ``secondary`` is the plain view's score without its aspect penalty. One row per group, gated. With ``side``,
    silhouettes are square masks of that many pixels an edge and appearances vectors of unit length; pairs are then
    compared in the best of four quarter turns, and ``turn`` is the one of the plain view.
    """
    # Family limits.
    lim = {"views": 6, "marked": 0.80, "plain": 0.55, "support": 3, "separation": 0.30, "consensus": 0.50, "detail": 2.5, "dissimilar": 0.10, "aspect": 0.28}
    lim |= limits or {}
    by = list(by)
    v = views.withColumn("_asp0", aspect).withColumn("_str", strict)
    kinds = {"primary": F.col(marking) >= lim["marked"], "secondary": F.col(marking) <= lim["plain"]}
    out = views.groupBy(*by).agg(F.count("*").alias("views"))
    for name, test in kinds.items():
        fam = settle(v.where(test))
        stats = join_same(fam.groupBy(*by).agg(F.count("*").alias(f"{name}_frames")), quantiles(fam, by, **{f"_{name}_mark": (F.col(marking).cast("double"), 0.5)}), by)
        best, members = stable_run(fam, by, time, order, gap, F.col("_asp0"), F.col("_str"), score, lim["support"], lim["aspect"])
        members = settle(members)
        if side is None:
            spread = pair_quantile(members, by, silhouette, [time, *order], 0.5, f"{name}_consensus")
        else:
            spread = aligned_quantile(members, by, silhouette, appearance, side, [time, *order], 0.5, f"{name}_consensus")
        support = members.groupBy(*by).agg(F.count("*").alias(f"{name}_support"))
        a = F.greatest(F.greatest(F.col("_asp0"), F.lit(1e-6)), 1 / F.greatest(F.col("_asp0"), F.lit(1e-6)))
        penalty = F.least(F.abs(F.log(a / F.col("median_aspect"))) / lim["aspect"], F.lit(1.0))
        choice = members.where("_str")
        if name == "primary":
            choice = choice.where(F.col(detail) >= lim["detail"])
        rank = F.round((F.col(score) if name == "primary" else F.col(secondary)) - 0.05 * penalty, 12)
        picked = choice.withColumn("_q", rank).withColumn("_t", -F.col(time))
        pick = best_by(picked, by, [F.col("_q"), F.col(score), F.col("_t")], [order[0], silhouette, appearance])
        pick = pick.select(*by, F.col(order[0]).alias(name), F.col(silhouette).alias(f"_{name}_s"), F.col(appearance).alias(f"_{name}_a"))
        for part in (stats, support, spread, pick):
            out = join_same(out, part, by, "left")
    gone = {c: F.coalesce(c, F.lit(0)) for c in ("primary_frames", "secondary_frames", "primary_support", "secondary_support")}
    out = out.withColumns(gone)
    # a run of one pair or more has a spread; without pairs it counts as 1
    out = out.withColumns({f"{n}_consensus": F.coalesce(f"{n}_consensus", F.lit(1.0)) for n in kinds})
    if side is None:
        both = 0.74 * arrays.mean_abs_diff("_primary_a", "_secondary_a") + 0.26 * arrays.mean_abs_diff("_primary_s", "_secondary_s")
    else:
        out = out.withColumn("_best", best_turn("_primary_s", "_secondary_s", "_primary_a", "_secondary_a", side)).withColumn("turn", F.col("_best.turn"))
        both = 0.74 * F.col("_best.appearance") + 0.26 * F.col("_best.silhouette")
    out = out.withColumn("separation", F.col("_primary_mark") - F.col("_secondary_mark")).withColumn("dissimilarity", both)
    return apply_gates(out.drop("_best"), [
        Rule("too_few_views", F.col("views") < lim["views"]),
        Rule("unsupported_families", (F.col("primary_frames") < lim["support"]) | (F.col("secondary_frames") < lim["support"])),
        Rule("families_not_separated", F.col("separation") < lim["separation"]),
        Rule("no_stable_family_run", (F.col("primary_support") == 0) | (F.col("secondary_support") == 0)),
        Rule("primary_consensus_too_low", F.col("primary_consensus") > lim["consensus"]),
        Rule("secondary_consensus_too_low", F.col("secondary_consensus") > lim["consensus"]),
        Rule("no_primary_view", F.col("primary").isNull()), Rule("no_secondary_view", F.col("secondary").isNull()),
        Rule("views_not_distinct", F.col("dissimilarity") < lim["dissimilar"]),
    ]).drop("_primary_mark", "_secondary_mark", "_primary_s", "_primary_a", "_secondary_s", "_secondary_a")
