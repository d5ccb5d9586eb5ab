"""Words one edit apart, by blocked Gram matrices of letter counts, and the forms they are variants of."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import partitions, pick, small_side, staged

#: Letters are a to z and what Latin-1 has from U+00C0 on; with A to Z lower-cased, each is one byte of Latin-1.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
#: Distinct words that a task holds while it counts a partition.
HELD = 200_000
#: Rows whose blocks are multiplied at once, and of a key's words that meet in one task, about.
BLOCK, CELL = 256, 4096


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, slips: int | None = None) -> DataFrame:
    """``word`` and ``n``: the runs of letters of all whole texts with A-Z lower-cased, ``least`` code points long or
    longer, and how often they occur. With ``slips``, a run of a document loses the code point h % length if that
    number divides h, the CRC-32 of ``<id>:<run>`` (a null id is written as nothing); what is left counts. Null texts
    have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from zlib import crc32

        runs, seen = re.compile(f"{LETTERS}{{{least},}}"), Counter()

        def give() -> pa.RecordBatch:
            words, counts = list(seen.keys()), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = Counter(runs.findall((t.as_py() or "").encode().lower().decode()))
                if slips:
                    head = b"%d:" % i if i is not None else b":"
                    start = crc32(head)
                    for w in [w for w in found if crc32(w.encode(), start) % slips == 0]:
                        k, n = crc32(w.encode(), start) % len(w), found.pop(w)
                        if len(w) > least:
                            seen[w[:k] + w[k + 1 :]] += n
                seen.update(found)
                if len(seen) > HELD:
                    yield give()
        yield give()

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(word: Column) -> Column:
    """Keys (kind, m, key) of which two words one edit apart share one. Of the halves of the shorter, m letters long,
    the one without the edit stands unchanged at the same end of the longer. A word may be either, hence m is its
    length or one less."""
    n, keys = F.length(word), []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        for kind, part in ((0, F.substr(word, F.lit(1), half)), (1, F.substr(word, n - (m - half) + 1, m - half))):
            keys.append(F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.xxhash64(F.lit(kind), m, part).alias("key")))
    return F.array(*keys)


def _matrix(words: list[bytes], dtype: type) -> np.ndarray:
    """Letters of each word in a row, as codes from 0, padded."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.zeros((len(words), int(size.max())), dtype=dtype)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out


def _counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts of padded rows, a column for each letter that occurs, in numbers whose products are exact."""
    letters = np.flatnonzero(np.bincount(codes.ravel(), minlength=256))
    letters = letters[letters > 0]
    column = np.zeros(256, dtype=np.int64)
    column[letters] = np.arange(1, len(letters) + 1)
    n, wide = len(codes), len(letters) + 1
    at = np.arange(n)[:, None] * wide + column[codes]
    out = np.bincount(at.ravel(), minlength=n * wide).reshape(n, wide)[:, 1:]
    return out.astype(np.float32 if codes.shape[1] <= 2048 else np.float64)


def near_pairs(words: list[bytes], group: np.ndarray, kind: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group whose words (Latin-1 bytes) are one edit apart, each once: i has length m, j
    has length m or m + 1.

    Squared distances of letter counts come from products of blocks. One replaced letter makes 2, one letter more or
    less 1. Pairs at those distances in adjacent lengths are verified letter by letter. A pair that shares both halves
    counts under the first one alone."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = _matrix(words, np.uint8)
    counts = _counts(codes)
    norm = (counts * counts).sum(axis=1)
    short = np.flatnonzero(size == m)
    ones, twos = [], []
    for a in range(0, len(short), 1024):
        rows = short[a : a + 1024]
        # rows are sorted by group, so a block meets a stretch of rows
        lo, hi = int(np.searchsorted(group, group[rows[0]])), int(np.searchsorted(group, group[rows[-1]], side="right"))
        for c in range(lo, hi, 4096):
            e = min(hi, c + 4096)
            d = norm[rows, None] + norm[None, c:e] - 2 * (counts[rows] @ counts[c:e].T)
            longer = size[None, c:e] - m[rows, None]
            ok = (group[rows, None] == group[None, c:e]) & (((longer == 0) & (d == 2) & (rows[:, None] < np.arange(c, e))) | ((longer == 1) & (d == 1)))
            i, j = np.nonzero(ok)
            ones.append(rows[i])
            twos.append(j + c)
    if not ones:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(ones), np.concatenate(twos)
    good = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), step := max(1, (4 << 20) // codes.shape[1])):
        x, y = i[a : a + step], j[a : a + step]
        good[a : a + step] = _one_edit(codes[x], codes[y], size[x], size[y]) & _first_half(codes[x], codes[y], size[x], size[y], kind[x])
    return i[good], j[good]


def _one_edit(x: np.ndarray, y: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether rows of x, n letters long, become rows of y, k = n or n + 1 long, by one edit."""
    width = x.shape[1]
    differ = x != y
    replaced = (k == n) & (differ.sum(axis=1) == 1)
    later = np.zeros_like(x)
    later[:, :-1] = y[:, 1:]
    apart = x != later
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    last = np.where(apart.any(axis=1), width - 1 - apart[:, ::-1].argmax(axis=1), -1)
    return replaced | ((k == n + 1) & (first > last))


def _first_half(x: np.ndarray, y: np.ndarray, n: np.ndarray, k: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a pair belongs to its key: kind 0 if the first halves agree, kind 1 if only the second ones do."""
    at = np.arange(x.shape[1])
    half = (n // 2)[:, None]
    head = ((x == y) | (at >= half)).all(axis=1)
    later = np.zeros_like(x)
    later[:, :-1] = y[:, 1:]
    moved = np.where((k > n)[:, None], later, y)
    tail = ((x == moved) | (at < half)).all(axis=1)
    return np.where(kind == 0, head, tail & ~head)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, cell, kind, m, side, word, n) sorted by key and cell: what each word learns from its block, as
    (word, n_near, form_n, form). Whole cells are gathered until they make a block."""
    held: list[tuple] = []
    widest = 0

    def give() -> Iterator[pa.RecordBatch]:
        nonlocal held, widest
        rows, held, widest = held, [], 0
        if len(rows) < 2:
            return
        key, cell, kind, m, side, word, n = (list(c) for c in zip(*rows))
        ids = np.cumsum([0] + [(a, b, c, d) != (e, f, g, h) for a, b, c, d, e, f, g, h in zip(key, cell, kind, m, key[1:], cell[1:], kind[1:], m[1:])])
        side = np.array(side)
        i, j = near_pairs([w.encode("latin-1") for w in word], ids, np.array(kind), np.array(m))
        if (side >= 0).any():  # cells of a split key: two parts that meet, or one that meets itself
            ok = (side[i] < 0) | (side[i] != side[j])
            i, j = i[ok], j[ok]
        if not len(i):
            return
        own, other = np.concatenate([i, j]), np.concatenate([j, i])
        times = np.array(n, dtype=np.int64)
        near = np.bincount(own, minlength=len(rows))
        order = np.lexsort((_places(word)[other], -times[other], own))
        best = other[order[np.append(True, own[order][1:] != own[order][:-1])]]
        mine = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays(
            [pa.array([word[k] for k in mine.tolist()], pa.string()), pa.array(near[mine]), pa.array(times[best]), pa.array([word[k] for k in best.tolist()], pa.string())],
            names=["word", "n_near", "form_n", "form"],
        )

    last = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:4] != last:
                last = row[:4]
                if len(held) >= BLOCK or len(held) * widest > 1 << 20:
                    yield from give()
            held.append(row)
            widest = max(widest, len(row[5]))
    yield from give()


def _places(words: list[str]) -> np.ndarray:
    """Place of each word among the distinct ones in code-point order."""
    at = {w: i for i, w in enumerate(sorted(set(words)))}
    return np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))


def near_words(words: DataFrame) -> DataFrame:
    """For each row of ``word`` (distinct), ``n``: ``word``, ``n``, ``n_near``, the number of other words one inserted,
    deleted or replaced code point away, and ``near``, the one of them with the largest n (ties: the smallest in
    code-point order) with ``near_n``, or nulls.

    Words are dealt out by halves (see ``_keys``) and compared within a key by :func:`near_pairs`. A key that more
    than CELL words have is split: its words are hashed into parts, and every two parts meet in a cell of their own,
    so a task holds two parts at most and no pair is lost. Only counts and best words leave a task.
    """
    keyed = words.select("word", "n", F.explode(_keys(F.col("word"))).alias("k")).select("word", "n", "k.kind", "k.m", "k.key")
    crowd = keyed.groupBy("kind", "m", "key").agg(F.count("*").alias("c")).where(F.col("c") > CELL)
    crowd = small_side(crowd.select("kind", "m", "key", F.ceil(F.col("c") / (CELL // 2)).cast("int").alias("parts")), 20)
    keyed = keyed.join(crowd, ["kind", "m", "key"], "left")
    part = F.pmod(F.xxhash64(F.lit("part"), "word"), F.col("parts").cast("long")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        (F.least(part, o) * F.col("parts") + F.greatest(part, o)).alias("cell"), F.when(o == part, F.lit(-1)).otherwise(F.when(part < o, 0).otherwise(1)).alias("side")))
    keyed = keyed.withColumn("c", F.explode(F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.lit(-1).alias("side")))).otherwise(cells)))
    keyed = keyed.select("key", "c.cell", "kind", "m", "c.side", "word", "n")
    dealt = keyed.repartition(partitions(words.sparkSession), "key", "cell").sortWithinPartitions("key", "cell", "kind", "m")
    learnt = dealt.mapInArrow(_meet, "word string, n_near long, form_n long, form string")
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<c:bigint,w:string>").alias("best"))
    learnt = learnt.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("form_n")).alias("c"), F.col("form").alias("w")).alias("best"))
    out = rows.unionByName(learnt).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", F.col("best.w").alias("near"), (-F.col("best.c")).alias("near_n"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, often: int = 2, times: int = 10, slips: int | None = None) -> DataFrame:
    """Words of whole texts, as :func:`count_words` finds them, that occur ``often`` times or more: ``word``, ``n``,
    ``n_near`` (see :func:`near_words`), ``form``: the near word of largest n, if that is ``times`` times the word's
    own n or more, else null, with ``form_n``; and ``root``: the last word that forms lead to, or the word itself.

    Words come in any number and order; null and empty texts have none, repeated rows count again, null ids are
    allowed, and other columns of ``docs`` play no part. Empty table: no rows.
    """
    if times < 2:
        raise ValueError("a form occurs more often than its variants")
    words = staged(count_words(docs, id_col, text_col, least, slips).where(F.col("n") >= often))
    near = near_words(words)
    is_form = F.col("near_n") >= times * F.col("n")
    found = staged(near.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    # roots of the distinct forms; each step doubles the way gone, and n grows tenfold with each form
    link = staged(found.where("form IS NOT NULL").select(F.col("form").alias("at")).distinct().join(found.select(F.col("word").alias("at"), "form"), "at").select("at", F.coalesce("form", "at").alias("to")))
    while True:
        ahead = small_side(link.where("at != to").select(F.col("at").alias("to"), F.col("to").alias("next")), 64)
        new = staged(link.join(ahead, "to", "left").select("at", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        link = new.select("at", "to")
        if not new.where("moved").limit(1).count():
            break
    roots = small_side(link.select(F.col("at").alias("form"), F.col("to").alias("root")), 64)
    return found.join(roots, "form", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
