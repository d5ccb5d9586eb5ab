"""Near copies of documents: SimHash links, checked by the Jaccard similarity of word shingles, and an exact
set-similarity self-join for the copies whose fingerprints lie further apart."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import partitions, pick, small_side, staged
from clipledger.llm.simhash import classes, fingerprints, links
from clipledger.session import settle

#: Share of all shingles, by their hash, that is counted over all documents, and a count at which counting ends.
LOW, CROWD = 0.28, 1000
#: Differing bits of fingerprints that are linked.
BITS = 2


def shingles(text: str | None, words: int, seed: int) -> np.ndarray:
    """Distinct XXH64 of the shingles of ``words`` words, ascending, made as in :func:`simhash.fingerprints`."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    n = max(len(w) - words + 1, min(1, len(w)))
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(w[i : i + words]), seed) for i in range(n)), dtype=np.uint64, count=n))


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes < np.uint64(int(LOW * 2**64))


def _sets(rows: DataFrame, words: int, seed: int) -> DataFrame:
    """``id``, ``h``, ``node`` (digest of the set), ``n`` (its size), ``low``: its shingles with a low hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            sets = [shingles(t.as_py(), words, seed) for t in b.column(2)]
            nodes = np.array([xxh64_intdigest(s.tobytes(), seed) for s in sets], dtype=np.uint64).view(np.int64)
            kept = [s[_low(s)].view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), listed], names=["id", "h", "node", "n", "low"])

    return rows.mapInArrow(run, "id long, h long, node long, n int, low array<long>")


def _high(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """``node``, ``key``: the shingles of texts whose hash is not low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, t in zip(b.column(0), b.column(1)):
                s = shingles(t.as_py(), words, seed)
                s = s[~_low(s)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node.as_py())), pa.array(s)], names=["node", "key"])

    return texts.select("node", "text").mapInArrow(run, "node long, key long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) sorted by both: the nodes of keys that several have, each once, with their number, or CROWD
    where they are as many or more. No more than CROWD rows of a key and a batch are held."""
    held = np.zeros((2, 0), dtype=np.int64)  # rows of the last key that are not given out yet
    given: int | None = None  # the last key, if it is crowded

    def give(rows: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.array(rows[0]), pa.array(df.astype(np.int32))], names=["node", "key", "df"])

    last: tuple[int, int] | None = None
    for b in batches:
        t = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        if not t.shape[1]:
            continue
        new = np.append(last != (t[0, 0], t[1, 0]), (t[:, 1:] != t[:, :-1]).any(axis=0))
        last = (int(t[0, -1]), int(t[1, -1]))
        t = t[:, new]
        if given is not None:  # more of a crowded key
            more = int(np.searchsorted(t[0], given, side="right"))
            if more:
                yield give(t[:, :more], np.full(more, CROWD))
            t = t[:, more:]
            if not t.shape[1]:
                continue
            given = None
        t = np.concatenate([held, t], axis=1)
        starts = np.flatnonzero(np.append(True, t[0, 1:] != t[0, :-1]))
        sizes = np.diff(np.append(starts, t.shape[1]))
        end = t.shape[1] if sizes[-1] >= CROWD else int(starts[-1])
        df = np.repeat(np.minimum(sizes, CROWD), sizes)[:end]
        yield give(t[:, :end][:, df > 1], df[df > 1])
        held, given = t[:, end:], int(t[0, -1]) if end == t.shape[1] else None
    if held.shape[1] > 1:
        yield give(held, np.full(held.shape[1], held.shape[1]))


def _counted(rows: DataFrame) -> DataFrame:
    """``node``, ``key``, ``df`` of shared keys (see :func:`_shared`)."""
    n = partitions(rows.sparkSession)
    return rows.select("key", "node").repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_shared, "node long, key long, df int")


def _members(own: DataFrame, rows: DataFrame, words: int, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The prefixes of sets in one global order, rare shingles first: ``key``, ``node``, ``n``, ``at``,
    ``common`` (mean count of its keys, zero for those that no other has); and the texts of their nodes. Sets with a Jaccard similarity of ``share`` share a key.

    Shingles with a low hash are counted over all documents. A set of which more low shingles stand in no other set
    than a similar one may lack has no partner and is done. The others bring all their shingles, and the rest of these
    is counted among them; so nobody's frequency is guessed, and few documents take part in the second count.
    """
    low = settle(_counted(own.select("node", F.explode("low").alias("key"))))
    nodes = own.groupBy("node").agg(F.max("n").alias("n"), F.max(F.size("low")).alias("lows"), F.min(F.struct("id", "h")).alias("place"))
    spare = (F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).cast("int")
    nodes = nodes.join(low.groupBy("node").agg(F.count("*").alias("_m")), "node", "left")
    open_ = nodes.where((F.col("n") > 0) & (F.col("lows") - F.coalesce("_m", F.lit(0)) < spare)).select("node", "n", spare.alias("p"), "place")
    open_ = small_side(open_, 40)
    places = open_.select(F.col("node"), F.col("place.id").alias("i"), F.col("place.h").alias("k"))
    texts = rows.join(F.broadcast(places) if _is_small(open_) else places, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select("node", "text")
    texts = staged(texts.dropDuplicates(["node"]))
    sizes = open_.select("node", "n", "p")
    high = _counted(_high(texts, words, seed))
    keyed = low.join(sizes, "node").withColumn("r", F.lit(0)).unionByName(high.join(sizes, "node").withColumn("r", F.lit(1)))
    own_keys = Window.partitionBy("node")  # no more rows than a text has shingles
    keyed = keyed.withColumn("_i", F.row_number().over(own_keys.orderBy("df", "r", "key"))).withColumn("_all", F.count("*").over(own_keys))
    keyed = keyed.withColumn("at", F.col("n") - F.col("_all") + F.col("_i") - 1).where("at < p").withColumn("common", F.sum("df").over(own_keys) / F.col("p"))
    return staged(keyed.select("key", "node", "n", F.col("at").cast("int").alias("at"), F.col("common").cast("float").alias("common"))), texts


def _is_small(df: DataFrame) -> bool:
    return df.count() * 40 <= 48 << 20


def _similar(pairs: DataFrame, texts: DataFrame, words: int, share: float, seed: int) -> DataFrame:
    """Of the pairs (src, dst) of nodes, those whose sets have a Jaccard similarity of ``share`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for b in batches:
            ok = np.zeros(b.num_rows, dtype=bool)
            for i in range(b.num_rows):
                x = b.column(0)[i].as_py()
                if x != last:
                    last, mine = x, shingles(b.column(2)[i].as_py(), words, seed)
                other = shingles(b.column(3)[i].as_py(), words, seed)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                ok[i] = both >= share * (len(mine) + len(other) - both) - 1e-9
            yield b.select([0, 1]).filter(pa.array(ok))

    one, two = texts.select(F.col("node").alias("src"), F.col("text").alias("x")), texts.select(F.col("node").alias("dst"), F.col("text").alias("y"))
    return settle(pairs.join(one, "src").join(two, "dst").select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long"))


def _linked(texts: DataFrame, seed: int) -> DataFrame:
    """Pairs (src, dst) of nodes by their SimHash: each node with the smallest of its fingerprint, and those of
    fingerprints that chains of up to BITS differing bits join with one of them."""
    prints = settle(fingerprints(texts, "node", "text", seed=seed))
    lead = settle(prints.groupBy("fingerprint").agg(F.min("id").alias("lead")))
    same = prints.join(lead, "fingerprint").where("id != lead").select("lead", F.col("id").alias("other"))
    one, two = lead.select(F.col("fingerprint").alias("src"), "lead"), lead.select(F.col("fingerprint").alias("dst"), F.col("lead").alias("other"))
    near = links(prints, BITS).join(one, "src").join(two, "dst").select("lead", "other")
    return same.unionByName(near).select(F.least("lead", "other").alias("src"), F.greatest("lead", "other").alias("dst")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``id``, ``h`` (xxhash64 of the text), ``component_id``: the smallest id that a chain of documents can reach, each
    of which has a Jaccard similarity of at least ``share`` with the next, taken on the sets of shingles of ``words``
    words (fewer words: all of them as one shingle); and ``first``: whether id and text are the class's first, by id,
    then ``h``.

    Exact: of a set of n shingles in a global order, the first n - ceil(share * n) + 1 are its keys; two similar sets
    share one (prefix filter), are about as large (length filter, by bands that a key is joined with) and have room for
    enough common shingles from the first common one on (positional filter). The order puts rare shingles first
    (:func:`_members`). Pairs that pass are compared by their whole sets. Equal sets are one node. First, nodes that
    SimHash links (two of 64 bits, :func:`simhash.links`) are compared, and each key's nodes with that of them whose
    keys are most common; both join large groups. Last, all nodes of a key that are still in different classes are compared with
    each other, so copies beyond SimHash's reach are found too.

    Texts without words and null texts are copies of each other. Null ids keep their row, are never first, and do not
    count as the smallest. Repeated rows each give a row, all of them first or none. Other columns of ``docs`` play no
    part. Empty table: no rows.
    """
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text")
    own = staged(_sets(rows, words, seed))
    members, texts = _members(own, rows, words, share, seed)
    fits = lambda a, b: F.least(a, b) >= F.ceil(share * F.greatest(a, b) - 1e-9)

    # each key's members meet the one with the most common keys: copies of one text have fewer words of their own, the
    # nearer they are to it
    hubs = small_side(members.groupBy("key").agg(F.max(F.struct("common", "node", "n")).alias("hub")), 32)
    stars = members.join(hubs, "key").where((F.col("node") != F.col("hub.node")) & fits(F.col("n"), F.col("hub.n")))
    stars = stars.select(F.least("node", "hub.node").alias("src"), F.greatest("node", "hub.node").alias("dst"))
    tried = settle(_linked(texts, seed).unionByName(stars).distinct())
    edges = _similar(tried, texts, words, share, seed)
    roots = small_side(classes(edges), 16)
    sides = settle(members.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"), "node", "n", "at"))
    busy = small_side(sides.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key"), 8)
    band = F.floor(F.log(F.col("n")) / math.log(1 / share) * (1 - 1e-9)).cast("int")
    sides = sides.join(busy, "key").withColumn("band", band)
    # each set waits in its own band and visits the next one, where sets that are a little larger wait
    ways = F.explode(F.array(F.struct(F.col("band").alias("b"), F.lit(False).alias("v")), F.struct((F.col("band") + 1).alias("b"), F.lit(True).alias("v"))))
    one = sides.withColumn("w", ways).select("key", F.col("w.b").alias("band"), F.col("w.v").alias("v"), F.struct("root", "node", "n", "at").alias("x"))
    two = sides.select("key", "band", F.struct("root", "node", "n", "at").alias("y"))
    total = F.ceil((F.col("x.n") + F.col("y.n")) * (share / (1 + share)) - 1e-9)
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    apart = one.join(two, ["key", "band"]).where((F.col("v") | (F.col("x.node") < F.col("y.node"))) & (F.col("x.root") != F.col("y.root")) & fits(F.col("x.n"), F.col("y.n")) & (room >= total))
    apart = apart.select(F.least("x.node", "y.node").alias("src"), F.greatest("x.node", "y.node").alias("dst")).distinct()
    more = _similar(apart.join(tried, ["src", "dst"], "left_anti"), texts, words, share, seed)
    roots = small_side(classes(edges.unionByName(more)), 16)
    # classes of several rows: the first place of each, for each of its nodes
    place = F.struct(F.col("id").isNull().alias("null"), "id", "h")
    nodes = own.groupBy("node").agg(F.min(place).alias("low"), F.count("*").alias("c")).join(roots, "node", "left")
    several = nodes.where("root IS NOT NULL OR c > 1").withColumn("root", F.coalesce("root", "node"))
    lowest = small_side(several.groupBy("root").agg(F.min("low").alias("low")), 32)
    table = small_side(several.select("node", "root").join(lowest, "root").select("node", "low"), 32)
    named = own.select("id", "h", "node").join(table, "node", "left")
    first = F.col("id").isNotNull() & (F.col("low").isNull() | ((F.col("low.id") == F.col("id")) & (F.col("low.h") == F.col("h"))))
    return named.select("id", "h", F.when(F.col("low").isNull(), F.col("id")).otherwise(F.col("low.id")).alias("component_id"), F.coalesce(first, F.lit(False)).alias("first"))
