"""SentencePiece ids of whole texts by vectorised merge rounds, and texts from ids."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import per_worker, pick

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Kinds of pieces and of models in the model file; fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
#: Bytes of text that are encoded at once, about; a longer text stands alone.
STRETCH = 4 << 20

codecs.register_error("clipledger_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces(dict):
    """A SentencePiece BPE model with byte fallback and no normalisation but blanks: ids as the library gives them.

    As a dictionary it maps a unit, which is a stretch of bytes in which every two neighbouring characters stand side
    by side in some piece, to its ids (little-endian int32). Merges never cross the rim of a unit, so units are encoded
    on their own. At most ``limit`` units are kept; then they become the older generation, from which units in use
    come back.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as proto

        super().__init__()
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and blanks ahead of words are known")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only models that leave texts as they are are known")
        kinds = np.array([p.type for p in model.pieces])
        if not set(kinds.tolist()) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("unused and user-defined pieces are not known")
        self.limit, self.old, self.dummy = limit, {}, b" " if norm.add_dummy_prefix else b""
        self.kinds = kinds
        texts = [p.piece.replace(SPACE, " ") for p in model.pieces]
        normal = [i for i in range(len(texts)) if kinds[i] == NORMAL]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_ids[int(texts[i][3:5], 16)] = i
        # symbols: pieces by their ids, then characters that are no pieces themselves
        symbol = {texts[i]: i for i in normal}
        for c in sorted({c for i in normal for c in texts[i]}):
            symbol.setdefault(c, len(texts) + len(symbol) - len(normal))
        self.base = max(symbol.values()) + 1
        single = sorted((ord(s), i) for s, i in symbol.items() if len(s) == 1)
        self.chars, self.char_symbols = (np.array(x, dtype=np.int64) for x in zip(*single))
        # the rank of a merge is that of its result's score, equal scores rank equally
        ranks = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal}, reverse=True))}
        pairs = {}
        for i in normal:
            t = texts[i]
            for k in range(1, len(t)):
                if t[:k] in symbol and t[k:] in symbol:
                    pairs[symbol[t[:k]] * self.base + symbol[t[k:]]] = (ranks[model.pieces[i].score], i)
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks, self.pair_ids = (np.array([pairs[k][j] for k in self.pair_keys.tolist()], dtype=np.int32) for j in (0, 1))
        # neighbouring bytes that stay together: within a character, and where some piece has both characters in a row
        joined = np.zeros((256, 256), dtype=bool)
        joined[:, 0x80:0xC0] = True
        for i in normal:
            for a, b in zip(texts[i], texts[i][1:]):
                joined[a.encode()[-1], b.encode()[0]] = True
        self.joined = joined.ravel()
        # what an id stands for in a text
        shown = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else (model.trainer_spec.unk_surface if k == UNKNOWN else t).encode() for t, k in zip(texts, kinds)]
        self.shown_sizes = np.array([len(s) for s in shown], dtype=np.int64)
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.blank = np.array([k == NORMAL and s[:1] == b" " for s, k in zip(shown, kinds)])

    def _merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of what two symbols make, NONE where they make nothing."""
        key = left * self.base + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NONE), self.pair_ids[at]

    def units(self, units: list[str]) -> list[bytes]:
        """Ids of units, together: flat arrays of symbols, the rank of each pair and the least rank of each unit. A
        round merges in every unit the pairs of that rank from the left, as long as none of them makes a pair that
        comes before the rest, which is the order of one merge at a time. Then arrays are compacted. Units without a
        pair leave."""
        data = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, data), len(self.chars) - 1)
        sym = np.where(self.chars[at] == data, self.char_symbols[at], -1 - data)  # a negative one stands for itself
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        out: list[bytes] = [b""] * len(units)
        who = np.flatnonzero(sizes)
        own = np.repeat(np.arange(len(who)), sizes[who])
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(own[1:] == own[:-1])
        rank[inner] = self._merge(sym[inner], sym[inner + 1])[0]
        while len(who):
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                ends = np.append(starts[1:], len(sym))
                flat, counts = self._ids(sym[np.repeat(done, ends - starts)])
                totals = np.add.reduceat(counts, np.cumsum(np.append(0, (ends - starts)[done]))[:-1])
                raw, to = flat.tobytes(), np.cumsum(totals) * 4
                for u, a, b in zip(who[done].tolist(), (to - totals * 4).tolist(), to.tolist()):
                    out[u] = raw[a:b]
                stay = np.repeat(~done, ends - starts)
                sym, rank, own, who, least = sym[stay], rank[stay], own[stay], who[~done], least[~done]
                own = np.repeat(np.arange(len(who)), (ends - starts)[~done])
                if not len(who):
                    break
            # pairs of the least rank; of overlapping ones every other, from the left
            here = np.flatnonzero(rank == least[own])
            fresh = np.append(True, (here[1:] != here[:-1] + 1) | (own[here[1:]] != own[here[:-1]]))
            heads = np.flatnonzero(fresh)
            place = np.arange(len(here)) - np.repeat(heads, np.diff(np.append(heads, len(here))))
            here = here[place % 2 == 0]
            made = self._merge(sym[here], sym[here + 1])[1].astype(np.int64)
            here, made = self._in_order(sym, own, here, made, least)
            sym[here] = made
            keep = np.ones(len(sym), dtype=bool)
            keep[here + 1] = False
            here = here - np.arange(len(here))
            sym, rank, own = sym[keep], rank[keep], own[keep]
            for i in (np.unique(np.concatenate([here, here - 1])),):
                i = i[i >= 0]
                inside = np.append(own[1:] == own[:-1], False)[i]
                rank[i[~inside]] = NONE
                i = i[inside]
                rank[i] = self._merge(sym[i], sym[i + 1])[0]
        return out

    def _in_order(self, sym: np.ndarray, own: np.ndarray, here: np.ndarray, made: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the merges of a round, those up to the first of each unit after which another pair is due."""
        several = np.bincount(own[here], minlength=len(least))[own[here]] > 1
        if not several.any():
            return here, made
        at, new = here[several], made[several]
        unit, n = own[at], len(sym)
        before = np.where(np.append(False, at[1:] == at[:-1] + 2), np.append(0, new[:-1]), sym[at - 1])
        has = (at > 0) & (own[at - 1] == unit)
        left = self._merge(np.where(has, before, -1), new)[0]
        after = np.minimum(at + 2, n - 1)
        has = (at + 2 < n) & (own[after] == unit)
        right = self._merge(new, np.where(has, sym[after], -1))[0]
        turn = np.minimum(left, right) <= least[unit]
        if not turn.any():
            return here, made
        # turns in the same unit ahead of a merge
        ahead = np.cumsum(turn) - turn
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        ahead -= np.repeat(ahead[first], np.diff(np.append(first, len(unit))))
        ok = np.ones(len(here), dtype=bool)
        ok[several] = ahead == 0
        return here[ok], made[ok]

    def _ids(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each has: characters that are no pieces become bytes."""
        odd = (sym < 0) | (sym >= len(self.kinds))
        counts = np.ones(len(sym), dtype=np.int64)
        if not odd.any():
            return sym.astype("<i4"), counts
        back = np.zeros(len(sym), dtype=np.int64)
        back[sym < 0] = -1 - sym[sym < 0]
        named = np.flatnonzero(sym >= len(self.kinds))
        if len(named):
            order = np.argsort(self.char_symbols)
            back[named] = self.chars[order[np.searchsorted(self.char_symbols[order], sym[named])]]
        lost = back[odd]
        counts[odd] = 1 + (lost > 0x7F) + (lost > 0x7FF) + (lost > 0xFFFF)
        out = np.empty(counts.sum(), dtype="<i4")
        place = np.repeat(odd, counts)
        out[~place] = sym[~odd]
        text = lost.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        out[place] = self.byte_ids[np.frombuffer(text, np.uint8)]
        return out, counts

    def _look_up(self, units: list[str]) -> list[bytes]:
        found = [self.get(u) for u in units]
        gap = [i for i, f in enumerate(found) if f is None]
        new = []
        for i in gap:
            found[i] = self.old.get(units[i])
            if found[i] is None:
                new.append(i)
        for group in _groups(new, [len(units[i]) for i in new], 1 << 19):
            for i, ids in zip(group, self.units([units[i] for i in group])):
                found[i] = ids
        for i in gap:
            if len(units[i]) <= 256:
                if len(self) >= self.limit:
                    self.old = dict(self)
                    self.clear()
                self[units[i]] = found[i]
        return found

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another (int32) and where each text's begin, with the total. With ``end``, that id
        follows each text. Null is empty."""
        raw = [self.dummy + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        tail = 0 if end is None else 1
        bounds = np.cumsum([0, *map(len, raw)])
        data = b"".join(raw)
        if not data:
            return np.full(len(raw) * tail, end or 0, dtype=np.int32), np.arange(len(raw) + 1) * tail
        b = np.frombuffer(data, np.uint8)
        cut = np.append(True, ~self.joined[(b[:-1].astype(np.int32) << 8) | b[1:]])
        cut[bounds[:-1][bounds[:-1] < len(b)]] = True
        cuts = np.flatnonzero(cut)
        coded = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(b)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        found = self._look_up(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<i4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        unit = coded.indices.to_numpy()
        n = sizes[unit]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[unit] - (ends - n), n) + np.arange(ends[-1])]
        offsets = np.append(0, ends)[np.searchsorted(cuts, bounds)]
        if end is None:
            return ids, offsets
        out, wide = np.full(len(ids) + len(raw), end, dtype=np.int32), offsets + np.arange(len(raw) + 1)
        keep = np.ones(len(out), dtype=bool)
        keep[wide[1:] - 1] = False
        out[keep] = ids
        return out, wide

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of ids: pieces in a row without the blank that the first one begins with, if the model puts one there;
        control pieces show nothing; bytes that are no UTF-8 become U+FFFD, each."""
        n = self.shown_sizes[ids]
        starts = self.shown_starts[ids]
        if self.dummy:
            # the first id of each text that is not a control piece
            real = np.append(0, np.cumsum(self.kinds[ids] != CONTROL))
            first = np.searchsorted(real[1:], real[offsets[:-1]] + 1)
            first = first[(first < offsets[1:])]
            first = first[self.blank[ids[first]]]
            n[first] -= 1
            starts = starts.copy()
            starts[first] += 1
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.shown[np.repeat(starts - (ends - n), n) + np.arange(total)].tobytes()
        at = np.append(0, ends)[offsets]
        wild = np.append(0, np.cumsum(self.kinds[ids] == BYTE))[offsets]
        texts, whole = [], wild[-1] == 0
        if not whole:
            try:
                for i in np.flatnonzero(np.diff(wild)):
                    raw[at[i] : at[i + 1]].decode()
                whole = True
            except UnicodeDecodeError:
                pass
        if whole:
            return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw))
        for i in range(len(at) - 1):
            texts.append(raw[at[i] : at[i + 1]].decode("utf-8", "clipledger_each_byte"))
        return pa.array(texts, pa.large_string())


def _groups(items: list, sizes: list[int], most: int) -> Iterator[list]:
    """Items in a row, about ``most`` in size at once; a larger item stands alone."""
    held, n = [], 0
    for x, s in zip(items, sizes):
        if held and n + s > most:
            yield held
            held, n = [], 0
        held.append(x)
        n += s
    if held:
        yield held


def pieces(path: str) -> Pieces:
    return per_worker(("pieces", path), lambda: Pieces(path))


def encode_decode(docs: DataFrame, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (array of int) and ``decoded``: the ids of each whole text in the SentencePiece model at
    ``path`` with ``end_id`` behind them, and the text that these ids give back. ``path`` is that of the file on every
    machine. Rows are taken one by one, so nothing is shuffled, and an id may be null or repeated.

    Null texts are empty; an empty text has the end id alone and decodes to an empty one. U+2581 in a text counts as
    a blank, as in the library. Other columns of ``docs`` play no part. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for rows in _groups(list(range(len(texts))), [len(t or "") for t in texts], STRETCH):
                ids, offsets = model.encode([texts[i] for i in rows], end_id)
                listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows[0], len(rows)), listed, model.decode(ids, offsets).cast(pa.string())], names=["id", "ids", "decoded"])

    return pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, ids array<int>, decoded string")
