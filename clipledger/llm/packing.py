"""Bounded-space online packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import pick, staged
from clipledger.llm.tokens import encoder

PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
SERIES_BITS, MERGE_FLAG = 32, 1 << 30


class Windows:
    """At most ``count`` open windows of ``size`` tokens. A piece goes whole into the window it fills best; where none
    has room, the fullest is topped up with the head of the piece and emitted, and the rest is placed the same way."""

    def __init__(self, size: int, count: int, series: int):
        self.size, self.count, self.series, self.made = size, count, series, 0
        self.open: list[list] = []  # [filled, pieces]
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at, name = 0, (self.series << SERIES_BITS) + self.made
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids) // 4, ids, total, name, at))
            at += len(ids) // 4
        self.made += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        size = self.size
        while ids:
            n = len(ids) // 4
            if n >= size:
                self.emit([(doc, start, ids[: 4 * size], total)])
                start, ids = start + size, ids[4 * size :]
                continue
            best = max((w for w in self.open if w[0] + n <= size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.count:
                self.open.append([n, [(doc, start, ids, total)]])
                return
            if best is not None:
                best[0] += n
                best[1].append((doc, start, ids, total))
                if best[0] == size:
                    self.emit(best[1])
                    self.open.remove(best)
                return
            fullest = max(self.open, key=lambda w: w[0])
            room = size - fullest[0]
            fullest[1].append((doc, start, ids[: 4 * room], total))
            self.emit(fullest[1])
            self.open.remove(fullest)
            start, ids = start + room, ids[4 * room :]

    def close(self) -> None:
        """Fill what is still open into whole windows; at most the last keeps room."""
        left, pieces, filled = sorted(self.open, key=lambda w: -w[0]), [], 0
        self.open = []
        for doc, start, ids, total in (p for w in left for p in w[1]):
            while ids:
                take = min(len(ids) // 4, self.size - filled)
                pieces.append((doc, start, ids[: 4 * take], total))
                start, ids, filled = start + take, ids[4 * take :], filled + take
                if filled == self.size:
                    self.emit(pieces)
                    pieces, filled = [], 0
        if pieces:
            self.emit(pieces)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.out[i : i + 4096]), ARROW.types)], schema=ARROW)
        self.out = []


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, windows: int = 16, end_id: int = 1, fan_in: int = 16) -> DataFrame:
    """Sequences of ``size`` tokens from whole texts, each text followed by ``end_id``. One row per piece: ``id``,
    ``start`` (the document's tokens before it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``
    (the document's length), ``sequence_id``, ``offset`` (the sequence's tokens before it, without gaps).

    Each input partition is one pass with ``windows`` open windows. What is still open at its end, at most
    ``windows`` windows, is merged with that of ``fan_in`` - 1 other partitions, so one sequence in ``fan_in``
    partitions is shorter than ``size``; every other is full and needs no padding. Pieces are written to the shared
    folder once, so that a lost executor cannot make the two steps disagree.

    Null and empty texts: a document of the end id alone. Rows with a repeated or null id are documents of their own.
    Empty table: no rows. Other columns of ``docs`` play no part.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        w = Windows(size, windows, part)
        for b in batches:
            names = b.column(0).to_pylist()
            for at, ids, cuts in enc.encode(b.column(1), end_id):
                ids, cuts = ids.astype("<u4").tobytes(), cuts.tolist()
                for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    w.add(names[at + i], 0, ids[4 * s : 4 * e], e - s)
                    if len(w.out) >= 4096:
                        yield from w.rows()
        for filled, pieces in w.open:  # left to merge: no sequence yet, the partition in its place
            w.out += [(doc, start, len(ids) // 4, ids, total, -1 - part, 0) for doc, start, ids, total in pieces]
        yield from w.rows()

    def merge(key, left: pa.Table) -> pa.Table:
        w = Windows(size, windows, MERGE_FLAG + key[0].as_py())
        rows = sorted(left.to_pylist(), key=lambda r: (r["sequence_id"], r["id"] is None, r["id"] or 0, r["start"], r["ids"]))
        for r in rows:
            w.add(r["id"], r["start"], r["ids"], r["doc_tokens"])
        w.close()
        return pa.Table.from_batches(w.rows(), schema=ARROW)

    pieces = staged(pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(first, PIECES))
    left = pieces.where("sequence_id < 0").withColumn("group", F.expr(f"(-1 - sequence_id) div {int(fan_in)}"))
    merged = left.groupBy("group").applyInArrow(lambda key, t: merge(key, t.drop_columns(["group"])), PIECES)
    return pieces.where("sequence_id >= 0").unionByName(merged)
