"""SimHash near-duplicates found through a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import partitions, per_worker, pick
from clipledger.session import settle

#: Perfect codes over consecutive bits of the fingerprint, 64 in all: (bits, generator polynomial, covering radius).
#: Two binary Golay codes, a Hamming code and a repetition code; fixed values.
CODES = ((23, 0b101011100011, 3), (23, 0b101011100011, 3), (15, 0b10011, 1), (3, 0b111, 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """64-bit SimHash of whole texts: ``id``, ``fingerprint`` (long). A-Z are lower-cased, words are runs without ASCII
    white space, shingles are ``words`` words with repeats (fewer words: all of them as one shingle), each hashed with
    XXH64. A bit is set if it is set in more than half of the hashes. No words or null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def votes(w: list[bytes], at: int, to: int) -> np.ndarray:
            h = np.fromiter((xxh64_intdigest(b" ".join(s), seed) for s in zip(*[w[at + i : to + i] for i in range(words)])), dtype="<u8", count=to - at)
            return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

        def one(text: str | None) -> int:
            w = (text or "").encode().lower().split()
            if not w:
                return 0
            if len(w) < words:
                return xxh64_intdigest(b" ".join(w), seed)
            n = len(w) - words + 1
            total = sum(votes(w, i, min(n, i + 65536)) for i in range(0, n, 65536))
            return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])

        for b in batches:
            prints = np.array([one(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["id", "fingerprint"])

    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, "id long, fingerprint long")


def _remainders(bits: int, poly: int) -> np.ndarray:
    """Syndrome of every single bit: x^i modulo the generator."""
    deg, out, r = poly.bit_length() - 1, [], 1
    for _ in range(bits):
        out.append(r)
        r <<= 1
        if r >> deg & 1:
            r ^= poly
    return np.array(out, dtype=np.int64)


class Block:
    """One perfect code: for each syndrome, the error patterns of weight up to ``radius + reach`` that have it, as a
    list. A word with that syndrome, changed by such a pattern, is a code word within that distance."""

    def __init__(self, bits: int, poly: int, radius: int, reach: int):
        self.bits, single = bits, _remainders(bits, poly)
        table: list[list[int]] = [[] for _ in range(1 << (poly.bit_length() - 1))]
        extra: list[list[int]] = [[] for _ in table]  # distance beyond the covering radius
        for weight in range(radius + reach + 1):
            for at in combinations(range(bits), weight):
                s = reduce(lambda a, i: a ^ int(single[i]), at, 0)
                table[s].append(sum(1 << i for i in at))
                extra[s].append(max(0, weight - radius))
        self.starts = np.cumsum([0] + [len(t) for t in table])
        self.patterns = np.array([p for t in table for p in t], dtype=np.uint64)
        self.cost = np.array([e for t in extra for e in t], dtype=np.int64)
        self.bytes = []  # syndrome of each byte value at each byte of the block
        for k in range(0, bits, 8):
            row = np.zeros(256, dtype=np.int64)
            for i in range(min(8, bits - k)):
                row ^= np.where(np.arange(256) >> i & 1, single[k + i], 0)
            self.bytes.append(row)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for k, row in enumerate(self.bytes):
            out ^= row[((x >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)]
        return out


def cover(prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs: every fingerprint with each code word of the product code that lies, block by block, within
    the covering radius plus a share of ``reach``."""
    blocks = per_worker(("cover", reach), lambda: [Block(*c, reach) for c in CODES])
    rows, anchors = np.arange(len(prints)), np.zeros(len(prints), dtype=np.uint64)
    left, at = np.full(len(prints), reach, dtype=np.int64), 0
    for b in blocks:
        part = ((prints >> np.uint64(at)) & np.uint64((1 << b.bits) - 1))[rows]
        s = b.syndrome(part)
        n = b.starts[s + 1] - b.starts[s]
        again = np.repeat(np.arange(len(rows)), n)
        pick_ = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.starts[s], n)
        # a code word within the radius is the nearest one; farther ones are paid from what is left of the reach
        near = b.cost[pick_]
        ok = near <= left[again]
        again, pick_, near = again[ok], pick_[ok], near[ok]
        anchors = anchors[again] ^ ((part[again] ^ b.patterns[pick_]) << np.uint64(at))
        rows, left, at = rows[again], left[again] - near, at + b.bits
    return rows, anchors


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (first, other) that connect what chains of up to ``bits`` differing bits join, one for each fingerprint
    but the first of its class. Compared one against the rest at a time, so memory is one row."""
    left, out = np.unique(prints), []
    while len(left):
        first, seen, left = int(left[0]), [left[0]], left[1:]
        while seen and len(left):
            near = np.bitwise_count((left ^ seen.pop()).view(np.uint64)) <= bits
            found, left = left[near], left[~near]
            out += [(first, x) for x in found.tolist()]
            seen += list(found)
    return out


def links(prints: DataFrame, bits: int = 2, limit: int = 4096) -> DataFrame:
    """Links (src, dst) among distinct fingerprints (column ``fingerprint``), enough of them that two fingerprints are
    connected exactly if a chain of steps of up to ``bits`` differing bits joins them.

    Anchor-point covering: the anchors are the words of a product of perfect codes over all 64 bits, whose covering
    radius R is the sum of the codes' radii. Two fingerprints at distance ``bits`` or less have a point between them,
    at most ``reach`` = ceil(bits / 2) steps from either; the anchor within R of that point is within R plus ``reach``
    of both. So the threshold is shared by the two sides: each fingerprint is replicated to all anchors within R plus
    ``reach`` (17 of 2^36 on average), and fingerprints are compared per anchor. Groups stay small because the number
    of anchors is far above that of documents, at any size.

    An anchor that more than ``limit`` fingerprints share is not gathered: its fingerprints are dealt anew with the
    trivial code, in which every point is an anchor and R is 0. Fingerprints that share such a point are within
    2 * ``reach`` bits, so for an even threshold each is linked with the smallest, without any comparison; it needs
    an even number of bits.
    """
    if bits < 0 or bits % 2:
        raise ValueError("the number of differing bits must be even")
    reach = bits // 2
    distinct = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(x), 8192):
                rows, anchors = cover(x[i : i + 8192], reach)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(x[i : i + 8192][rows].view(np.int64))], names=["anchor", "fingerprint"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor. Links, and with dst null the fingerprints of crowded anchors."""
        held, crowded = np.zeros((2, 0), dtype=np.int64), None
        for b in chain(batches, [None]):
            if b is not None:
                held = np.concatenate([held, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])], axis=1)
            n = held.shape[1]
            if n == 0:
                continue
            starts = np.flatnonzero(np.r_[True, held[0, 1:] != held[0, :-1]])
            ends, keep = np.r_[starts[1:], n], n
            found: list[tuple[int, int | None]] = []
            matter = ends - starts > 1
            matter[[0, -1]] = True  # the first may go on a crowded anchor, the last may go on in the next batch
            for s, e in zip(starts[matter], ends[matter]):
                if held[0, s] == crowded or e - s > limit:
                    crowded = held[0, s]
                    found += [(x, None) for x in held[1, s:e].tolist()]
                elif e == n and b is not None:
                    keep = s
                elif e - s > 1:
                    found += _forest(held[1, s:e], bits)
            held = held[:, keep:]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["src", "dst"])

    n = partitions(prints.sparkSession)
    anchored = distinct.mapInArrow(spread, "anchor long, fingerprint long").repartition(n, "anchor").sortWithinPartitions("anchor")
    found = settle(anchored.mapInArrow(compare, "src long, dst long").distinct())
    close = found.where("dst IS NOT NULL")
    crowd = found.where("dst IS NULL").select("src").distinct()
    points = crowd.select("src", F.explode(F.concat(F.array(F.col("src")), *[_flips(r) for r in range(1, reach + 1)])).alias("point"))
    star = points.groupBy("point").agg(F.min("src").alias("first"), F.max("src").alias("last")).where("first < last").select("point", "first")
    dealt = points.join(star, "point").where("src != first").select(F.col("first").alias("src"), F.col("src").alias("dst"))
    return close.unionByName(dealt).distinct()


def _flips(r: int):
    """All points ``r`` steps from column src."""
    masks = [reduce(lambda a, i: a | 1 << i, c, 0) for c in combinations(range(64), r)]
    return F.array(*[F.col("src").bitwiseXOR(F.lit(m - (1 << 64) if m >= 1 << 63 else m)) for m in masks])


def classes(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (src, dst): ``node`` → ``root``, its class's smallest node. Each round
    takes the smallest root in the neighbourhood and then the root's root; both are joins of (node, long) rows."""
    both = settle(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = settle(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        seen = both.join(now, both.dst == now.node).groupBy("src").agg(F.min("root").alias("low"))
        near = now.join(seen, now.node == seen.src).select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        above = now.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = settle(near.join(above, "root").select("node", "old", F.least("root", "up").alias("root")))
        now = new.select("node", "root")
        if new.where("old != root").isEmpty():
            return now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """``id``, ``fingerprint`` (long), ``component_id``: the smallest id that a chain of fingerprints, each within
    ``bits`` differing bits of the next, can reach.

    Texts without words and null texts have fingerprint 0, linked like any other. Null ids keep their row; their
    component is the smallest id present in it (null if none is). Repeated rows each give a row. Empty table: no rows.
    Other columns of ``docs`` play no part.
    """
    own = settle(fingerprints(docs, id_col, text_col, words, seed))
    first = own.groupBy("fingerprint").agg(F.min("id").alias("least"))
    roots = classes(links(own, bits))
    named = first.join(roots, first.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    low = named.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    table = named.join(low, "root").select("fingerprint", "component_id")
    return own.join(table, "fingerprint").select("id", "fingerprint", "component_id")
