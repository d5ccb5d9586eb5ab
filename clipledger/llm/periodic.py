"""Runs of words that repeat with a period, by Baier grouping, and texts without the repetitions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import pick

#: Bytes of text that are searched at once, about; a longer text stands alone.
STRETCH = 4 << 20
FAR = 2**62


def lyndon(text: list[int], reverse: bool = False) -> list[int]:
    """For each place, the length of the longest Lyndon word that begins there, under the order of numbers or its
    reverse; the end of the text is smaller than all.

    The grouping phase of Baier's suffix sorting: suffixes start in groups of their first symbols. From the highest
    group down, each of a group's suffixes looks for the nearest suffix to its left in a lower group. That one's
    Lyndon word takes in those of all suffixes that found it, so it moves to a new group right above its own, the
    more of them the higher. When a group's turn comes, its common prefix is the longest Lyndon word of its members.
    """
    n = len(text)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by.setdefault(c, []).append(i)
    members = [by[c] for c in sorted(by, reverse=reverse)]
    size, group = [1] * len(members), [0] * n
    for g, some in enumerate(members):
        for i in some:
            group[i] = g
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    length, link, g = [0] * n, [-2] * n, len(members) - 1
    while g >= 0:
        k, found, times = size[g], [], []
        for s in members[g]:
            if group[s] != g:
                continue
            j, walked = s - 1, []
            while j >= 0 and link[j] != -2:
                walked.append(j)
                j = link[j]
            for x in walked[:-1]:
                link[x] = j
            link[s], length[s] = j, k
            if j >= 0:
                if found and found[-1] == j:
                    times[-1] += 1
                else:
                    found.append(j)
                    times.append(1)
        for t in sorted(set(times), reverse=True):
            made: dict[int, int] = {}
            for p, c in zip(found, times):
                if c != t:
                    continue
                old = group[p]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    size.append(size[old] + t * k)
                    up = upper[old]
                    lower.append(old)
                    upper.append(up)
                    upper[old] = new
                    lower[up] = new
                group[p] = new
                members[new].append(p)
        g = lower[g]
    return length


class Extensions:
    """How far two places of a row of symbols agree, to the right or left: names of all blocks of each power of two."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.names = [codes]
        while 2 << len(self.names) - 1 <= longest:
            half, last = 1 << len(self.names) - 1, self.names[-1]
            if len(last) <= half:
                break
            self.names.append(np.unique(last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:], return_inverse=True)[1])

    def right(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Common length of what begins at i and at j > i, before ``end``."""
        n = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            for _ in range(2 if k == len(self.names) - 1 else 1):
                ok = np.flatnonzero(j + n + (1 << k) <= end)
                at = ok[self.names[k][i[ok] + n[ok]] == self.names[k][j[ok] + n[ok]]]
                n[at] += 1 << k
        return n

    def left(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Common length of what ends ahead of i and ahead of j > i, from ``begin`` on."""
        n = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            for _ in range(2 if k == len(self.names) - 1 else 1):
                ok = np.flatnonzero(i - n - (1 << k) >= begin)
                at = ok[self.names[k][i[ok] - n[ok] - (1 << k)] == self.names[k][j[ok] - n[ok] - (1 << k)]]
                n[at] += 1 << k
        return n


def _stretches(codes: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs can be: begin, end and text of stretches that hold all runs long enough, each with what lies around.

    Behind its first q words, a run of period q has only words seen at most q words before, and there are at least
    exponent - 1 times q of them. So words go whose last place lies further back than their stretch allows, until none
    does. That drops no run; whether it has one is left to the search.
    """
    order = np.argsort(codes, kind="stable")
    back = np.full(len(codes), FAR)
    same = codes[order[1:]] == codes[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    floor = min(max(least, exponent * q) - q for q in range(1, least + 1))
    text = np.searchsorted(bounds, np.arange(len(codes)), side="right") - 1
    alive = np.flatnonzero(back < FAR)
    for _ in range(64):
        new = np.flatnonzero(np.append(True, (alive[1:] != alive[:-1] + 1) | (text[alive[1:]] != text[alive[:-1]]))) if len(alive) else np.zeros(0, np.int64)
        m = np.diff(np.append(new, len(alive)))
        size = np.repeat(m, m)
        ok = (size >= floor) & (back[alive] <= size // (exponent - 1))
        if ok.all():
            break
        alive = alive[ok]
    else:
        new = np.flatnonzero(np.append(True, (alive[1:] != alive[:-1] + 1) | (text[alive[1:]] != text[alive[:-1]])))
        m = np.diff(np.append(new, len(alive)))
    begin, owner = alive[new], text[alive[new]]
    return np.maximum(begin - m // (exponent - 1) - 1, bounds[owner]), begin + m, owner


def runs_of(texts: list[list[bytes]], least: int, exponent: int) -> list[np.ndarray]:
    """For each list of words, its runs as rows (start, length, period), by start, then period."""
    codes, at = [], 0
    for words in texts:
        names: dict[bytes, int] = {}
        new = count(at)
        codes += [names.setdefault(w, x) for w, x in zip(words, new)]
        at += len(words)
    codes = np.array(codes, dtype=np.int64)
    bounds = np.cumsum([0, *map(len, texts)])
    none = np.zeros((0, 3), dtype=np.int64)
    out = [none] * len(texts)
    if not len(codes):
        return out
    begin, end, owner = _stretches(codes, bounds, least, exponent)
    if not len(begin):
        return out
    # stretches one after another, with the two Lyndon arrays of each
    sizes = end - begin
    ends = np.cumsum(sizes)
    starts = ends - sizes
    flat = codes[np.repeat(begin - starts, sizes) + np.arange(ends[-1])]
    spot, period, part = [], [], []
    for k in range(len(begin)):
        some = flat[starts[k] : ends[k]]
        text = np.unique(some, return_inverse=True)[1].tolist()
        for reverse in (False, True):
            p = np.array(lyndon(text, reverse), dtype=np.int64)
            i = np.flatnonzero(np.arange(len(p)) + p < len(p))
            i = i[some[i] == some[i + p[i]]]
            spot.append(i + starts[k])
            period.append(p[i])
            part.append(np.full(len(i), k))
    spot, period, part = map(np.concatenate, (spot, period, part))
    reach = Extensions(np.unique(flat, return_inverse=True)[1], int(sizes.max()))
    first = spot - reach.left(spot, spot + period, starts[part])
    last = spot + period + reach.right(spot, spot + period, ends[part])
    # one that begins with its stretch, inside a text, is the rest of a run of a stretch before
    whole = (first > starts[part]) | (begin[part] == bounds[owner[part]])
    ok = (last - first >= np.maximum(least, exponent * period)) & whole
    part, period = part[ok], period[ok]
    found = np.stack([owner[part], first[ok] - starts[part] + begin[part] - bounds[owner[part]], (last - first)[ok], period], axis=1)
    found = np.unique(found, axis=0)
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    for d in np.unique(found[:, 0]).tolist():
        out[d] = found[cuts[d] : cuts[d + 1], 1:]
    return out


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``id``, ``n_words``, ``runs`` (array of start, length, period, by start, then period; words from 0) and
    ``collapsed``: the words of the text, joined by one blank, without those that a run holds after its first period.

    Words are what stands between ASCII white space. A run is a stretch of words with smallest period q, at least
    ``least`` and ``exponent`` times q words long, that no neighbouring word extends. Each has a root that is the
    longest Lyndon word at its place under one of the two orders; Baier's grouping gives both Lyndon arrays, and a
    root is extended to its run by the longest common extensions of two places a period apart.

    Rows are taken one by one, so nothing is shuffled and ids may be null or repeated. Null, empty and blank texts
    have no words and no runs. Other columns of ``docs`` play no part. Empty table: no rows. ``exponent`` is a whole
    number from 2 on.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(at: int, ids: pa.Array, texts: list) -> pa.RecordBatch:
            words = [(t or "").encode().split() for t in texts]
            runs = runs_of(words, least, exponent)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat.T], ["start", "length", "period"]))
            joined = [b" ".join(_kept(w, r) if len(r) else w).decode() for w, r in zip(words, runs)]
            return pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array([len(w) for w in words], pa.int64()), listed, pa.array(joined, pa.string())], names=["id", "n_words", "runs", "collapsed"])

        for b in batches:
            at, held, n = 0, [], 0
            for t in b.column(1):
                t = t.as_py()
                if held and n + len(t or "") > STRETCH:
                    yield group(at, b.column(0), held)
                    at, held, n = at + len(held), [], 0
                held.append(t)
                n += len(t or "")
            if held:
                yield group(at, b.column(0), held)

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
