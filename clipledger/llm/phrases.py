"""Document fingerprints from locally consistent parsing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import dealt_in_order, pick

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Lowest set bit times this number has its position in the top six bits.
DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
POSITION = np.zeros(64, dtype=np.uint64)
with np.errstate(over="ignore"):
    for _i in range(64):
        POSITION[int((np.uint64(1 << _i) * DEBRUIJN) >> np.uint64(58))] = _i


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


#: Lowest bit in which two labels below 128 differ, twice that plus the bit of the second; equal ones do not meet.
AGAIN = np.array([[2 * ((a ^ b) & -(a ^ b)).bit_length() - 2 + (b >> ((a ^ b) & -(a ^ b)).bit_length() - 1 & 1) if a != b else 0 for b in range(128)] for a in range(128)], dtype=np.uint8).ravel()


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing, twice: the label of a name is twice the lowest bit in which it differs from its left neighbour,
    plus that bit; then the same of the labels. Neighbours that differ get labels that differ, below 14. ``first``:
    where a text begins; its first name counts as different in bit 0."""
    d = np.empty_like(names)
    d[1:], d[0] = names[1:] ^ names[:-1], np.uint64(1)
    d[first] = np.uint64(1)
    at = POSITION[((d & (~d + np.uint64(1))) * DEBRUIJN) >> np.uint64(58)]
    label = ((at << np.uint64(1)) | ((names >> at) & np.uint64(1))).astype(np.int16)
    pair = np.empty_like(label)
    pair[1:], pair[0] = (label[:-1] << 7) | label[1:], 0
    out = AGAIN[pair]
    out[first] = label[first] & 1
    return out


def _level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and where each text begins in them. Runs of one name become a symbol; the sequence,
    in which neighbours now differ, is cut at local maxima of labels tossed twice; a block's name is a hash of its
    symbols in order."""
    n = len(names)
    new = np.empty(n, dtype=bool)
    new[0], new[1:] = True, names[1:] != names[:-1]
    new[first] = True
    runs = np.flatnonzero(new)
    length = np.diff(np.append(runs, n)).astype(np.uint64)
    names = _mix(names[runs] + length * A)
    first = np.searchsorted(runs, first)
    label = _toss(names, first)
    n = len(names)
    cut = np.zeros(n, dtype=bool)
    if n > 2:
        cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    cut[first] = True
    last = np.append(first[1:], n) - 1
    alone = last > first
    cut[last[alone]] = False  # a block has a right neighbour to compare with
    starts = np.flatnonzero(cut)
    at = (np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(names + (at + np.uint64(1)) * A), starts)), np.searchsorted(starts, first)


def sketches(texts: list[str], size: int = 64, least_level: int = 2) -> list[np.ndarray]:
    """For each text, the ``size`` smallest distinct 32-bit hashes of its phrase names from level ``least_level`` up
    (a text too short to have one: of its last level). Names depend on a phrase and a few symbols around it alone, so
    equal stretches of two texts share all names but those at their rims, wherever they stand."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    codes = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4") for i in full]
    sizes = np.array([len(c) for c in codes])
    keys, owner = [], np.arange(len(full))
    with np.errstate(over="ignore"):
        names, first, level = _mix(np.concatenate(codes).astype(np.uint64) + A), np.cumsum(sizes) - sizes, 0
        while len(names):
            names, first = _level(names, first)
            level += 1
            n = np.diff(np.append(first, len(names)))
            ended = n == 1
            doc = np.repeat(owner, n)
            use = np.ones(len(names), dtype=bool) if level >= least_level else np.repeat(ended, n)
            keys.append((doc[use].astype(np.uint64) << np.uint64(32)) | (_mix(names[use] + np.uint64(level) * C) >> np.uint64(32)))
            go = np.repeat(~ended, n)
            names, n, owner = names[go], n[~ended], owner[~ended]
            first = np.cumsum(n) - n
    key = np.sort(np.concatenate(keys))
    key = key[np.append(True, key[1:] != key[:-1])]
    doc = (key >> np.uint64(32)).astype(np.int64)
    starts = np.searchsorted(doc, np.arange(len(full) + 1))
    for k, i in enumerate(full):
        out[i] = key[starts[k] : min(starts[k + 1], starts[k] + size)] & np.uint64(0xFFFFFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = 64) -> float:
    """Share of common phrases, from 0 to 1: of the ``size`` smallest hashes of both together, those that both have.
    Two empty texts: 1."""
    one, two = set(a.tolist()), set(b.tolist())
    if not one and not two:
        return 1.0
    least = sorted(one | two)[:size]
    return sum(x <= least[-1] for x in one & two) / len(least)


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 64) -> DataFrame:
    """``id`` and ``fingerprint`` (8 hex digits for each of up to ``size`` hashes) of whole texts. Null and empty
    texts: the empty string. Rows are taken one by one, whatever their ids; other columns of ``docs`` play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in _stretches(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at[0], len(at[1])), pa.array([text_of(s) for s in sketches(at[1], size)])], names=["id", "fingerprint"])

    return pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(run, "id long, fingerprint string")


def _stretches(texts: list, chars: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """Stretches of about ``chars`` code points at most; a longer text stands alone."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and n + len(t) > chars:
            yield at, held
            at, held, n = i, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield at, held


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one, as far as that goes."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NEXT = "id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 64) -> DataFrame:
    """Fingerprints of each whole text, of its edited text (see :func:`edited`) and how alike they are, and how alike
    the text and the next document's are: ``id``, ``n_chars`` (code points), ``edited_text``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. The next document is that of the next larger id; after the
    last comes the first. Texts travel once, range-partitioned by id; a task streams its range.

    Null ids come first, equal ids by their texts. Null texts are empty. A lone document follows itself. Empty table:
    no rows. Other columns of ``docs`` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, over = None, False  # the row before, with its sketch

        def pairs(ids: list, texts: list[str]) -> Iterator[tuple]:
            nonlocal last
            own = sketches(texts, size)
            if last is not None:
                ids, texts, own = [last[0], *ids], [last[1], *texts], [last[2], *own]
            last = (ids[-1], texts[-1], own[-1])
            news = [edited(a, b) for a, b in zip(texts, texts[1:])]
            for i, (e, s) in enumerate(zip(news, sketches(news, size))):
                yield ids[i], len(texts[i]), e, text_of(own[i]), text_of(s), likeness(own[i], s, size), likeness(own[i], own[i + 1], size)

        for b in batches:
            if over:
                break
            ids, texts, ahead = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist()
            if True in ahead:  # the first copy of the next partition's first document ends this one
                ids, texts, over = ids[: ahead.index(True) + 1], texts[: ahead.index(True) + 1], True
            for at, some in _stretches(texts):
                rows = list(pairs(ids[at : at + len(some)], some))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], names=["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        for _ in batches:
            pass

    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return dealt_in_order(rows, "id", "text", ahead=True).select("id", "text", "ahead").mapInArrow(run, NEXT)
