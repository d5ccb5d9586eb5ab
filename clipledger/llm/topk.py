"""Exact top-k search by inner product with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import dealt_in_order, pick, staged

#: Sums of whole products below this are exact in the type, narrowest first.
EXACT = ((np.float32, 2.0**24), (np.float64, 2.0**53))
#: Stands for a score that is not there.
NONE = -(2**63) + 1
HITS = "query_uid long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` and ``v``: floor(scale * x) of every component, as longs. Rows with a null id or vector, or with a null or
    non-finite component, are left out."""
    x = pick(vectors, id=id_col, v=vector_col).where("id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return x.where(~bad).select(F.col("id").cast("long").alias("id"), F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def _narrow(m: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not m.size or (m.min() >= np.iinfo(kind).min and m.max() <= np.iinfo(kind).max):
            return m.astype(kind)
    return m


def _kind(q: np.ndarray, most: float):
    """The narrowest type that holds every sum of products of a row of ``q`` with values up to ``most`` exactly."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * most * max(q.shape[1], 1)
    return next((kind for kind, limit in EXACT if top < limit), object)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled with zeros."""
    n = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), int(n.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


def _lists(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _fit(m: np.ndarray, dims: int) -> np.ndarray:
    return m[:, :dims] if m.shape[1] >= dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def index(vectors: DataFrame, block_rows: int = 256) -> DataFrame:
    """Forward index of quantised vectors: blocks of ``block_rows`` rows that follow each other in id order.

    A row is a block: ``part``, ``first`` (position of its first row in the part), ``ids``, ``matrix`` (rows by
    components, packed), ``width`` (bytes of a component), ``dims``, ``high`` and ``low`` (largest and smallest value
    of each component in the block, the bounds of its terms). Shorter vectors are filled with zeros. It is written to
    the shared folder once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, n, pieces = TaskContext.get().partitionId(), 0, 0, []

        def block() -> pa.RecordBatch:
            ids, rows = (c.combine_chunks() for c in pa.Table.from_batches(pieces).columns)
            m = _matrix(rows)
            packed = _narrow(m)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "first": at, "ids": ids.to_pylist(), "matrix": packed.tobytes(), "width": packed.itemsize, "dims": m.shape[1], "high": m.max(axis=0).tolist(), "low": m.min(axis=0).tolist()}], schema=kinds
            )

        for b in batches:
            while len(b):
                pieces.append(b.slice(0, block_rows - n))
                b, n = b.slice(block_rows - n), n + len(pieces[-1])
                if n == block_rows:
                    yield block()
                    at, n, pieces = at + block_rows, 0, []
        if pieces:
            yield block()

    longs = pa.list_(pa.int64())
    kinds = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("ids", longs), ("matrix", pa.binary()), ("width", pa.int32()), ("dims", pa.int32()), ("high", longs), ("low", longs)])
    return staged(dealt_in_order(vectors, "id", "v").mapInArrow(build, "part int, first long, ids array<long>, matrix binary, width int, dims int, high array<long>, low array<long>"))


class _Part:
    """The blocks of one part, and queries run against them."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: r["first"])
        self.dims = max((r["dims"] for r in self.rows), default=0)
        self.high, self.low = (_fit(_matrix(pa.array([r[c] for r in self.rows], pa.list_(pa.int64()))), self.dims) for c in ("high", "low"))
        self.blocks = [np.frombuffer(r["matrix"], f"<i{r['width']}").reshape(len(r["ids"]), r["dims"]) for r in self.rows]
        self.ids = [np.array(r["ids"], dtype=np.int64) for r in self.rows]
        self.most = max((float(np.abs(b.astype(np.float64)).max()) for b in self.blocks if b.size), default=0.0)

    def run(self, uid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The part's best ``k`` rows for each query with their scores (-1 and ``NONE`` where there are fewer):
        blocks in the order of their bounds, until a bound is below the k-th score or ``floor``. ``uid`` names the
        query's own row, which is no candidate.

        Queries take their first block, then the next 4, 16 and so on, so that a block is multiplied with all queries that
        have their turn with it and still need it. Only scores that reach a query's k-th are ranked."""
        q = _fit(q, self.dims)
        kind = _kind(q, self.most)
        up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        bounds = self.high.astype(kind) @ up.T + self.low.astype(kind) @ down.T  # a row for each block
        turn = np.argsort(np.argsort(-bounds, axis=0, kind="stable"), axis=0)
        q = q.astype(kind)
        score = np.full((len(q), k), NONE, dtype=np.int64)
        ids = np.full((len(q), k), -1, dtype=np.int64)
        part = self.rows[0]["part"] if self.rows else 0
        home = bool((uid >> 33 == part).any())
        least, done, end = np.maximum(floor, NONE), 0, 1
        while done < len(self.blocks):
            go = (turn >= done) & (turn < end) & (bounds >= least)
            if not go.any():
                break
            for b in np.flatnonzero(go.any(axis=1)):
                who = np.flatnonzero(go[b] & (bounds[b] >= least))
                m = self.blocks[b]  # may lack the last components: zeros
                s = q[who, : m.shape[1]] @ m.T.astype(kind)
                near = s >= least[who, None].astype(kind)
                if home:
                    own = uid[who] - ((part << 33) + self.rows[b]["first"])
                    hit = np.flatnonzero((own >= 0) & (own < s.shape[1]))
                    near[hit, own[hit]] = False
                at, row = np.divmod(np.flatnonzero(near), s.shape[1])
                if len(at):
                    _add(ids, score, who[at], self.ids[b][row], s[at, row].astype(np.int64))
                    least = np.maximum(floor, score[:, -1])
            done, end = end, 4 * end + 1
        return ids, score


def _add(ids: np.ndarray, score: np.ndarray, at: np.ndarray, new_ids: np.ndarray, new_score: np.ndarray) -> None:
    """Put candidates of the rows ``at`` (ascending) into the rows' best, in place: highest score first, ties to the
    smaller id."""
    k, first = score.shape[1], np.concatenate([[True], at[1:] > at[:-1]])
    rows = at[first]
    of = np.concatenate([np.repeat(np.arange(len(rows)), k), np.cumsum(first) - 1])
    names, points = np.concatenate([ids[rows].ravel(), new_ids]), np.concatenate([score[rows].ravel(), new_score])
    order = np.lexsort((names, -points, of))
    best = order[np.searchsorted(of[order], np.arange(len(rows)))[:, None] + np.arange(k)]
    ids[rows], score[rows] = names[best], points[best]


def top_k(blocks: DataFrame, k: int = 5, every: int = 50, batch: int = 256) -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` other rows with the highest inner product (all, if
    there are fewer), ties to the smaller id: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Each query first runs against its own part of the index, which gives a k-th score to start from. Bounds of whole
    parts (the largest and smallest value of each component) then decide which other parts it is sent to; there it
    meets the part's blocks in the order of their bounds, the sum over components of the larger of value times maximum
    and value times minimum, and is scored through a block's forward index until the bounds fall below its k-th score.
    A bound that equals it is followed, so ties are exact. A task holds one part; queries stream past it. The bounds of
    parts, two numbers a component for each partition of the index, are what the driver hands out.
    Rows that repeat an id are rows of their own, each its own query. Empty index: no rows.
    """
    parts, high, low = _bounds(blocks)
    dims, most = high.shape[1], float(np.abs(np.stack([high, low]).astype(np.float64)).max(initial=0))
    number = _narrow(np.stack([high, low])).dtype  # of every component

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has whole parts, sorted. Each query's start, as a row of its own."""
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            p = _Part(held)
            at = [np.flatnonzero(b % every == 0) for b in p.ids]
            uid = np.concatenate([(r["part"] << 33) + r["first"] + i for r, i in zip(p.rows, at)])
            names = np.concatenate([b[i] for b, i in zip(p.ids, at)])
            q = np.concatenate([_fit(m[i], dims) for m, i in zip(p.blocks, at)])
            for s in range(0, len(uid), batch):
                some = slice(s, s + batch)
                ids, score = p.run(uid[some], q[some], np.full(len(uid[some]), NONE), k)
                yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(names[some]), _lists(q[some].astype(number)), _lists(ids), _lists(score)], names=["uid", "id", "q", "ids", "scores"])

        for b in batches:
            for row in b.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield from done()
                    held = []
                held.append(row)
        if held:
            yield from done()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, q, floor = b["uid"].to_numpy(), _fit(_matrix(b["q"]), dims), _fit(_matrix(b["scores"]), k)[:, -1]
            kind = _kind(q, most)
            bounds = np.maximum(q, 0).astype(kind) @ high.T.astype(kind) + np.minimum(q, 0).astype(kind) @ low.T.astype(kind)
            i, j = np.nonzero((bounds >= floor[:, None]) & (parts[None, :] != (uid >> 33)[:, None]))
            for s in range(0, len(i), 4096):
                r = i[s : s + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(parts[j[s : s + 4096]].astype(np.int32)), pa.array(uid[r]), b["id"].take(pa.array(r)), b["q"].take(pa.array(r)), pa.array(floor[r])], names=["part", "uid", "id", "q", "floor"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by part, its blocks before the queries that come to it."""
        held, at, p = [], None, None
        for b in batches:
            part = b["part"].to_numpy()
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            for s, e in zip(starts, [*starts[1:], len(part)]):
                if part[s] != at:
                    held, at, p = [], part[s], None
                rows = b.slice(s, e - s)
                n = rows["uid"].null_count  # blocks
                held += rows.slice(0, n).to_pylist()
                for i in range(n, len(rows), batch):
                    some = rows.slice(i, batch)
                    p = p or _Part(held)
                    uid = some["uid"].to_numpy()
                    ids, score = p.run(uid, _matrix(some["q"]), some["floor"].to_numpy(), k)
                    r, c = np.nonzero(score > NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(uid[r]), some["id"].take(pa.array(r)), pa.array(ids[r, c]), pa.array(score[r, c])], names=["query_uid", "query_id", "vec_id", "score"])

    q_type = f"array<{ {2: 'smallint', 4: 'int', 8: 'bigint'}[number.itemsize] }>"
    names = ["part", "first", "ids", "matrix", "width", "dims", "high", "low"]
    at_home = staged(blocks.repartitionById(int(parts.max(initial=0)) + 1, "part").sortWithinPartitions("part", "first").select(*names).mapInArrow(own, f"uid long, id long, q {q_type}, ids array<long>, scores array<long>"))
    sent = at_home.mapInArrow(send, f"part int, uid long, id long, q {q_type}, floor long")
    both = blocks.select(*names).unionByName(sent, allowMissingColumns=True)
    away = both.repartitionById(int(parts.max(initial=0)) + 1, "part").sortWithinPartitions("part", F.col("uid").asc_nulls_first(), "first").mapInArrow(meet, HITS)
    near = at_home.select(F.col("uid").alias("query_uid"), F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("z")).select("query_uid", "query_id", F.col("z.ids").alias("vec_id"), F.col("z.scores").alias("score")).where(F.col("score") > NONE)
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return near.unionByName(away).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part numbers and the largest and smallest value of each component in a part; a component that some block of
    the part lacks is 0 there."""
    each = blocks.select("part", F.posexplode(F.arrays_zip("high", "low")).alias("c", "z"))
    each = each.groupBy("part", "c").agg(F.max("z.high").alias("high"), F.min("z.low").alias("low"), F.count("*").alias("n")).collect()
    size = {r["part"]: r["count"] for r in blocks.groupBy("part").count().collect()}
    parts = np.array(sorted(size), dtype=np.int64)
    high = np.zeros((len(parts), max((r["c"] + 1 for r in each), default=0)), dtype=np.int64)
    low = high.copy()
    for r in each:
        at, some = np.searchsorted(parts, r["part"]), r["n"] < size[r["part"]]
        high[at, r["c"]], low[at, r["c"]] = max(r["high"], 0) if some else r["high"], min(r["low"], 0) if some else r["low"]
    return parts, high, low
