"""Views folded over points and voxel grids, one view at a time.

Work comes in units: a bounded share of a clip's points, or a block of its grid. A task reads a unit and then, in
order, the views of its clip, and keeps one number or two for each point, so neither points nor pairs are shuffled per
view and a clip may have any number of views. Grids travel as one row per block; their voxels first appear in the
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.session import join_same

CAMERA = ["rotation", "translation", "focal", "cx", "cy", "k1", "width", "height"]
#: Points of a unit, about; voxels along a block's edge, at most; voxels along a brick's edge.
UNIT, BLOCK, BRICK = 1 << 17, 96, 8
#: Slack of bounds of pixels, far above rounding and far below a pixel.
SLACK = 1e-6
POINTS, VIEWS, END = 0, 1, 2


class View:
    """One view in a task: camera numbers and whatever arrays were asked for."""

    def __init__(self, row: dict):
        self.rotation, self.translation = [float(x) for x in row["rotation"]], [float(x) for x in row["translation"]]
        self.focal, self.cx, self.cy, self.k1 = (float(row[c]) for c in ("focal", "cx", "cy", "k1"))
        self.width, self.height = int(row["width"]), int(row["height"])
        self.row = row

    def project(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pixel and depth, in the operations of ``geometry.project``."""
        r, t = self.rotation, self.translation
        xc, yc, zc = (r[3 * i] * x + r[3 * i + 1] * y + r[3 * i + 2] * z + t[i] for i in range(3))
        safe = np.where(zc > 1e-9, zc, 1.0)
        xn, yn = xc / safe, yc / safe
        bend = 1 + self.k1 * (xn * xn + yn * yn)
        return self.focal * xn * bend + self.cx, self.focal * yn * bend + self.cy, zc

    def pixels(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, rounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether points lie in front and in the image, their pixel's number, and their depth. The image ends at its
        width and height, before rounding to the nearest pixel within it, or after, if ``rounded``."""
        u, v, depth = self.project(x, y, z)
        ui, vi = np.rint(u), np.rint(v)
        a, b = (ui, vi) if rounded else (u, v)
        inside = (depth > 1e-9) & (a >= 0) & (b >= 0) & (a < self.width) & (b < self.height)
        at = np.clip(vi, 0, self.height - 1) * self.width + np.clip(ui, 0, self.width - 1)
        return inside, np.where(inside, at, 0).astype(np.int64), depth

    def mask(self) -> np.ndarray:
        words = np.asarray(self.row["mask"], dtype=np.int64)
        bits = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)
        n = self.width * self.height
        return bits[:n] if len(bits) >= n else np.append(bits, np.zeros(n - len(bits), dtype=bool))


def _views(batch: pa.RecordBatch, at: int, to: int) -> Iterator[View]:
    column = batch.column(batch.schema.get_field_index("_v"))
    names = [f.name for f in column.type]
    parts = column.slice(at, to - at).flatten()
    for i in range(to - at):
        yield View({n: p[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(p.type) and p[i].is_valid else p[i].as_py() for n, p in zip(names, parts)})


def _stream(points: DataFrame, views: DataFrame, ends: DataFrame, by: list[str], view: str, fields: Sequence[str]) -> DataFrame:
    """Rows of units in the order of work: points (``_p``), then views (``_v``), then the end of the unit. All three
    frames have ``by`` and ``_unit``."""
    p_type, v_type = points.schema["_p"].dataType, T.StructType([views.schema[c] for c in fields])
    none = lambda kind: F.lit(None).cast(kind)
    order_type = views.schema[view].dataType
    rows = points.select(*by, "_unit", F.lit(POINTS).alias("_kind"), none(order_type).alias("_order"), "_p", none(v_type).alias("_v"))
    rows = rows.unionByName(views.select(*by, "_unit", F.lit(VIEWS).alias("_kind"), F.col(view).alias("_order"), none(p_type).alias("_p"), F.struct(*fields).alias("_v")))
    rows = rows.unionByName(ends.select(*by, "_unit", F.lit(END).alias("_kind"), none(order_type).alias("_order"), none(p_type).alias("_p"), none(v_type).alias("_v")))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by, "_unit").sortWithinPartitions(*by, "_unit", "_kind", "_order")


def _run(rows: DataFrame, schema: T.StructType, start: Callable, step: Callable, finish: Callable) -> DataFrame:
    """``start(table)`` makes the state of a unit, ``step(state, view)`` adds a view, ``finish(state, table)`` gives
    the columns of the result."""
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        table = state = None
        for b in batches:
            kinds = b.column(b.schema.get_field_index("_kind")).to_numpy()
            cuts = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])) if len(kinds) else []
            for at, to in zip(cuts, [*cuts[1:], len(kinds)]):
                at, to = int(at), int(to)
                if kinds[at] == POINTS:
                    held.append(b.slice(at, to - at))
                    continue
                if state is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    state = start(table)
                if kinds[at] == VIEWS:
                    if state is not None:
                        for v in _views(b, at, to):
                            step(state, v)
                    continue
                if state is not None:
                    done = finish(state, table)
                    for a in range(0, len(done[names[0]]), 1 << 16):
                        yield pa.RecordBatch.from_arrays([done[n].slice(a, 1 << 16) for n in names], names=names)
                held, table, state = [], None, None

    return rows.mapInArrow(work, schema)


def _column(table: pa.Table, name: str) -> pa.Array:
    """A field of the points, or a key column."""
    if name in table.column_names:
        return table.column(name).combine_chunks()
    return table.column("_p").combine_chunks().field(name)


def fold_points(points: DataFrame, views: DataFrame, by: Sequence[str], view: str, fields: Sequence[str], keep: Sequence[str], added: Sequence[T.StructField], start: Callable, step: Callable, finish: Callable) -> DataFrame:
    """Points (x, y, z) of each clip with all its views, in ascending order of ``view``: the columns ``by`` and ``keep``
    of the points and those ``added``. ``start(n)`` makes the state of n points, ``step(state, view, x, y, z)`` folds a
    view in, ``finish(state)`` gives (rows that stay or None, arrays of the added columns). Points without views keep
    their state from the start. Clips with more than UNIT points are dealt out over several units by a hash."""
    by, keep = list(by), list(keep)
    inner = [c for c in dict.fromkeys([*keep, "x", "y", "z"])]
    units = points.groupBy(*by).agg(F.ceil(F.count("*") / UNIT).cast("int").alias("_units"))
    share = F.pmod(F.xxhash64(*[F.col(c) for c in inner]), F.col("_units").cast("long")).cast("int")
    p = join_same(points, units, by).select(*by, share.alias("_unit"), F.struct(*[F.col(c).cast("double").alias(c) if c in "xyz" else F.col(c) for c in inner]).alias("_p"))
    each = F.explode(F.sequence(F.lit(0), F.col("_units") - 1)).alias("_unit")
    v = join_same(views.select(*by, *dict.fromkeys([view, *fields])), units, by)
    v = v.select("*", each)
    rows = _stream(p, v, units.select(*by, each), by, view, fields)
    types = [points.schema[c] for c in by] + [T.StructField(c, T.DoubleType()) if c in "xyz" else points.schema[c] for c in keep] + list(added)

    def begin(table: pa.Table):
        return [_column(table, c).to_numpy(zero_copy_only=False) for c in "xyz"], start(table.num_rows)

    def onward(state, v: View) -> None:
        step(state[1], v, *state[0])

    def end(state, table: pa.Table) -> dict:
        rows_left, extra = finish(state[1])
        out = {c: _column(table, c) for c in by + keep}
        if rows_left is not None:
            out = {c: a.take(pa.array(rows_left)) for c, a in out.items()}
        return out | {f.name: pa.array(a) for f, a in zip(added, extra)}

    return _run(rows, T.StructType(types), begin, onward, end)


class Blocks:
    """A block of a grid as bricks of BRICK cells along each edge: cell centres, bounds of bricks and their voxels."""

    def __init__(self, first: Sequence[int], shape: Sequence[int], low: float, step: float):
        self.first, self.shape, self.low, self.step = list(first), list(shape), low, step
        self.bricks = [-(-n // BRICK) for n in shape]
        b = np.indices(self.bricks).reshape(3, -1) * BRICK  # first cell of each brick, z y x
        self.at = b + np.array(first)[:, None]
        self.last = np.minimum(self.at + BRICK, (np.array(first) + np.array(shape))[:, None]) - 1
        self.count = self.at.shape[1]
        inner = np.indices((BRICK, BRICK, BRICK)).reshape(3, -1)
        cells = self.at[:, :, None] + inner[:, None, :]  # 3, bricks, 512
        self.real = (cells <= self.last[:, :, None]).all(axis=0)
        self.inner = inner

    def centre(self, index: np.ndarray) -> np.ndarray:
        return self.low + index * self.step

    def points(self, brick: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, y, z of cells."""
        z, y, x = (self.centre(self.at[k][brick] + self.inner[k][cell]) for k in range(3))
        return x, y, z

    def reach(self, v: View, brick: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bounds of the pixels of whole bricks: whether all of a brick is in front, least and largest u and v. Depth
        is linear and x / z, y / z take their extremes at corners; the bend is bounded by the range of the radius."""
        lo, hi = self.centre(self.at[:, brick]), self.centre(self.last[:, brick])
        corner = [np.where(np.array([k >> a & 1 for k in range(8)])[:, None], hi[a], lo[a]) for a in range(3)]
        r, t = v.rotation, v.translation
        xc, yc, zc = (r[3 * i] * corner[2] + r[3 * i + 1] * corner[1] + r[3 * i + 2] * corner[0] + t[i] for i in range(3))
        front = zc.min(axis=0) > 1e-6
        safe = np.where(zc > 1e-6, zc, 1.0)
        xn, yn = xc / safe, yc / safe
        (a, b), (c, d) = ((n.min(axis=0), n.max(axis=0)) for n in (xn, yn))
        square = lambda p, q: (np.where((p <= 0) & (q >= 0), 0.0, np.minimum(p * p, q * q)), np.maximum(p * p, q * q))
        (x0, x1), (y0, y1) = square(a, b), square(c, d)
        bend = np.sort(np.stack([1 + v.k1 * (x0 + y0), 1 + v.k1 * (x1 + y1)]), axis=0)

        def bounds(p: np.ndarray, q: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
            ends = np.stack([v.focal * e * f for e in (p, q) for f in bend])
            least, most = ends.min(axis=0) + shift, ends.max(axis=0) + shift
            pad = SLACK * (1 + np.abs(least) + np.abs(most))
            return least - pad, most + pad

        return front, *bounds(a, b, v.cx), *bounds(c, d, v.cy)


def _carve_view(state: dict, v: View) -> None:
    """Add a view's rejections. Bricks whose pixels are all in the mask or all out of it are decided whole by the
    mask's summed-area table; the others, where the mask's edge or the image's border crosses, voxel by voxel."""
    g, limit, reject = state["blocks"], state["limit"], state["reject"]
    live = np.flatnonzero(state["live"])
    if not len(live):
        return
    mask = v.mask()
    w, h = v.width, v.height
    area = np.zeros((h + 1, w + 1), dtype=np.int32)
    np.cumsum(np.cumsum(mask.reshape(h, w), axis=0, dtype=np.int32), axis=1, out=area[1:, 1:])
    front, u0, u1, v0, v1 = g.reach(v, live)
    if reject:  # the image's rim is half a pixel out
        shift = 0.5
        inside = front & (u0 > -0.5) & (v0 > -0.5) & (u1 < w - 0.5) & (v1 < h - 0.5)
    else:
        shift = 0.0
        inside = front & (u0 >= 0) & (v0 >= 0) & (u1 < w) & (v1 < h)
    outside = front & ((u1 < -shift - SLACK) | (v1 < -shift - SLACK) | (u0 > w - shift + SLACK) | (v0 > h - shift + SLACK))
    clip = lambda a, n: np.clip(np.rint(a), 0, n - 1).astype(np.int64)
    a, b, c, d = clip(u0, w), clip(u1, w) + 1, clip(v0, h), clip(v1, h) + 1
    hits = area[d, b] - area[c, b] - area[d, a] + area[c, a]
    missed = (inside & (hits == 0)) | (outside & reject)
    settled = missed | outside | (inside & (hits == (b - a) * (d - c)))
    state["whole"][live[missed]] += 1
    mixed = live[~settled]
    if len(mixed):
        brick, cell = np.nonzero(state["real"][mixed] & (state["votes"][mixed] + state["whole"][mixed, None] <= limit))
        brick = mixed[brick]
        for k in range(0, len(brick), 1 << 18):
            i, j = brick[k : k + (1 << 18)], cell[k : k + (1 << 18)]
            seen, at, _ = v.pixels(*g.points(i, j), rounded=reject)
            miss = np.where(seen, ~mask[at], reject)
            state["votes"][i[miss], j[miss]] += 1
    least = np.where(state["real"][live], state["votes"][live], np.int32(2**30)).min(axis=1) + state["whole"][live]
    state["live"][live[least > limit]] = False


def carve_grid(clips: DataFrame, views: DataFrame, by: Sequence[str], view: str, resolution: int, low: float = -1.0, high: float = 1.0, limit: int = 0, outside: str = "abstain") -> DataFrame:
    """Voxels of a cubic grid of each clip (a row of ``clips`` with its key) that at most ``limit`` of its views reject:
    the rows of ``surfaces.carve`` over ``surfaces.voxel_grid``, with iz, iy, ix, x, y, z and ``rejections``.

    A clip's grid is cut into blocks of BLOCK voxels along an edge at most, the units of work. Within, bricks are
    decided whole where a view's mask allows it, and once all voxels of a brick are lost, no further view is asked.
    """
    if outside not in ("abstain", "reject"):
        raise ValueError("outside must be abstain or reject")
    by = list(by)
    step = (high - low) / (resolution - 1)
    units, edge = _blocks(clips.select(*by), resolution)
    fields = [*CAMERA, "mask"]
    v = join_same(views.select(*by, *dict.fromkeys([view, *fields])), units.select(*by, "_unit"), by)
    rows = _stream(units, v, units, by, view, fields)
    schema = T.StructType([clips.schema[c] for c in by] + [T.StructField(f"i{c}", T.IntegerType()) for c in "zyx"] + [T.StructField(c, T.DoubleType()) for c in "xyz"] + [T.StructField("rejections", T.LongType())])

    def start(table: pa.Table) -> dict:
        g = _block(table, resolution, edge, low, step)
        return {"blocks": g, "limit": limit, "reject": outside == "reject", "real": g.real, "votes": np.zeros(g.real.shape, np.int32), "whole": np.zeros(g.count, np.int32), "live": np.ones(g.count, bool)}

    def finish(state: dict, table: pa.Table) -> dict:
        g = state["blocks"]
        total = state["votes"] + state["whole"][:, None]
        brick, cell = np.nonzero(g.real & (total <= limit) & state["live"][:, None])
        index = {f"i{c}": g.at[k][brick] + g.inner[k][cell] for k, c in enumerate("zyx")}
        out = {c: _column(table, c).take(pa.array(np.zeros(len(brick), np.int64))) for c in by}
        out |= {c: pa.array(i.astype(np.int32)) for c, i in index.items()}
        return out | {c: pa.array(g.centre(index[f"i{c}"])) for c in "xyz"} | {"rejections": pa.array(total[brick, cell].astype(np.int64))}

    return _run(rows, schema, start, _carve_view, finish)


def _blocks(clips: DataFrame, resolution: int) -> tuple[DataFrame, int]:
    """Rows of a grid's blocks, with the block's number as the only point, and a block's edge."""
    parts = math.ceil(resolution / BLOCK)
    edge = -(-math.ceil(resolution / parts) // BRICK) * BRICK
    number = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(resolution / edge) ** 3 - 1))).alias("_unit")
    return clips.select("*", number).withColumn("_p", F.struct(F.col("_unit").alias("block"))), edge


def _block(table: pa.Table, resolution: int, edge: int, low: float, step: float) -> Blocks:
    n, parts = int(_column(table, "block")[0].as_py()), math.ceil(resolution / edge)
    first = [n // parts**2 * edge, n // parts % parts * edge, n % parts * edge]
    return Blocks(first, [min(edge, resolution - f) for f in first], low, step)


def support(points: DataFrame, views: DataFrame, by: Sequence[str], keep: Sequence[str], view: str) -> DataFrame:
    """``support``: the number of views whose mask holds the pixel of each point."""

    def step(state: np.ndarray, v: View, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
        seen, at, _ = v.pixels(x, y, z, rounded=False)
        state += seen & v.mask()[at]

    return fold_points(points, views, by, view, [*CAMERA, "mask"], keep, [T.StructField("support", T.LongType())], lambda n: np.zeros(n, np.int64), step, lambda s: (None, [s]))


def votes(points: DataFrame, views: DataFrame, by: Sequence[str], keep: Sequence[str], view: str, limit: int | None, reject: bool) -> DataFrame:
    """``rejections`` of each point; points above ``limit`` are left out, and no further view is asked about them."""

    def step(state: np.ndarray, v: View, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
        i = np.arange(len(state)) if limit is None else np.flatnonzero(state <= limit)
        seen, at, _ = v.pixels(x[i], y[i], z[i], rounded=reject)
        state[i] += np.where(seen, ~v.mask()[at], reject)

    def finish(state: np.ndarray) -> tuple:
        if limit is None:
            return None, [state]
        left = np.flatnonzero(state <= limit)
        return left, [state[left]]

    return fold_points(points, views, by, view, [*CAMERA, "mask"], keep, [T.StructField("rejections", T.LongType())], lambda n: np.zeros(n, np.int64), step, finish)


def depth_edges(depth: np.ndarray, extent: float, limit: float) -> np.ndarray:
    """Where a depth image (rows by columns) jumps: the 3 by 3 Sobel gradient, the image mirrored at its rim without
    repeating it, above ``limit`` times ``extent``."""
    d = np.pad(depth.astype(np.float64), 1, mode="reflect" if min(depth.shape) > 1 else "edge")
    smooth = d[:-2] + 2 * d[1:-1] + d[2:]
    gx = smooth[:, 2:] - smooth[:, :-2]
    smooth = d[:, :-2] + 2 * d[:, 1:-1] + d[:, 2:]
    gy = smooth[2:] - smooth[:-2]
    return np.hypot(gx, gy) / max(extent, 1e-9) > limit


def fuse_views(points: DataFrame, views: DataFrame, by: Sequence[str], keep: Sequence[str], view: str, mu: float, extent: float | None, edge_limit: float) -> DataFrame:
    """``tsdf`` and ``weight`` of each point from depth views: see ``surfaces.fuse``."""
    fields = [*CAMERA, "depth_map", *[c for c in ("conf_map", "depth_conf") if c in views.columns]]

    def step(state: np.ndarray, v: View, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
        depth = np.asarray(v.row["depth_map"], dtype=np.float64)
        if extent is not None:
            depth = np.where(depth_edges(depth.reshape(v.height, v.width), extent, edge_limit).ravel(), 0.0, depth)
        seen, at, own = v.pixels(x, y, z, rounded=False)
        i = np.flatnonzero(seen & (depth[at] > 1e-6))
        sdf = (depth[at[i]] - own[i]) / mu
        i, sdf = i[sdf >= -1], sdf[sdf >= -1]
        trust = 1.0 if v.row.get("depth_conf") is None else float(v.row["depth_conf"])
        if v.row.get("conf_map") is not None:
            trust = np.asarray(v.row["conf_map"], dtype=np.float64)[at[i]] * trust
        w = trust / np.maximum(own[i], 1e-6)
        state[0, i] += w * np.minimum(sdf, 1.0)
        state[1, i] += w

    def finish(state: np.ndarray) -> tuple:
        seen = state[1] > 0
        mean = np.divide(state[0], state[1], out=np.zeros(state.shape[1]), where=seen)
        return None, [pa.array(mean, mask=~seen), state[1]]

    return fold_points(points, views, by, view, fields, keep, [T.StructField("tsdf", T.DoubleType()), T.StructField("weight", T.DoubleType())], lambda n: np.zeros((2, n)), step, finish)


def dilate(voxels: DataFrame, by: Sequence[str], resolution: int, rounds: int = 2) -> DataFrame:
    """Cells (iz, iy, ix) of each grid within ``rounds`` steps along its axes of an occupied one.

    Cells are packed into bricks of 8 by 8 by 8 bits. A brick hands copies of its cells to the neighbours whose rim
    they touch, so each brick is grown on its own, by shifts of a small cube; bits, not cells, are shuffled.
    """
    by = list(by)
    if not 1 <= rounds <= BRICK:
        raise ValueError("between one step and a brick's edge")
    n, wide, last = -(-resolution // BRICK), BRICK + 2 * rounds, resolution - 1
    # bricks whose cube, the brick with a rim of ``rounds`` cells, holds the cell
    near = lambda c: F.sequence(F.floor(F.greatest(F.col(c) - rounds, F.lit(0)) / BRICK), F.floor(F.least(F.col(c) + rounds, F.lit(last)) / BRICK))
    d = voxels.select(*by, "iz", "iy", "ix").where(" AND ".join(f"i{c} BETWEEN 0 AND {last}" for c in "zyx"))
    for c in "zyx":
        d = d.withColumn(f"_{c}", F.explode(near(f"i{c}")))
    inner = lambda c: F.col(f"i{c}") - F.col(f"_{c}") * BRICK + rounds
    at = ((inner("z") * wide + inner("y")) * wide + inner("x")).cast("long")
    brick = ((F.col("_z") * n + F.col("_y")) * n + F.col("_x")).alias("_brick")
    words = d.select(*by, brick, F.shiftright(at, 6).alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("_bit"))
    words = words.groupBy(*by, "_brick", "_w").agg(F.bit_or("_bit").alias("_bits"))
    cubes = words.groupBy(*by, "_brick").agg(F.collect_list(F.struct("_w", "_bits")).alias("_ws"))
    schema = T.StructType([voxels.schema[c] for c in by] + [T.StructField(f"i{c}", T.IntegerType()) for c in "zyx"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bricks, owner, cells = b.column(len(by)).to_numpy(), [], []
            for i, ws in enumerate(b.column(len(by) + 1).to_pylist()):
                cube = np.zeros(-(-(wide**3) // 64), dtype=np.int64)
                for w in ws:
                    cube[w["_w"]] = w["_bits"]
                cube = np.unpackbits(cube.view(np.uint8), bitorder="little")[: wide**3].astype(bool).reshape(wide, wide, wide)
                for _ in range(rounds):
                    grown = cube.copy()
                    for axis in range(3):
                        a, c = [slice(None)] * 3, [slice(None)] * 3
                        a[axis], c[axis] = slice(1, None), slice(None, -1)
                        grown[tuple(a)] |= cube[tuple(c)]
                        grown[tuple(c)] |= cube[tuple(a)]
                    cube = grown
                core = slice(rounds, rounds + BRICK)
                k = int(bricks[i])
                found = np.stack(np.nonzero(cube[core, core, core])) + np.array([[k // n**2], [k // n % n], [k % n]]) * BRICK
                found = found[:, (found <= last).all(axis=0)]
                owner.append(np.full(found.shape[1], i))
                cells.append(found)
            if owner:
                at, found = pa.array(np.concatenate(owner)), np.concatenate(cells, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(len(by))], *[pa.array(r) for r in found]], names=schema.names)

    return cubes.mapInArrow(work, schema)
