"""Token ids of whole texts with the tokenizers library, one encoding per distinct word and worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa

from clipledger.llm.common import per_worker

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: White space to Unicode but not in ASCII's class: texts that hold it are encoded whole.
ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
PLAIN = re.compile(rf" ?[{LETTERS}]+")
WHITE = " \t\n\r\f\v"
#: Bytes of text that are cut into pieces at once, about; a longer text stands alone.
STRETCH = 8 << 20


class Encoder(dict):
    """Token ids of whole texts: texts are cut into pieces at places where the tokenizer's own splitter certainly cuts,
    distinct pieces are encoded by the library, and ids are put together again; so they are those of the whole text.

    As a dictionary it maps a piece to its little-endian unsigned 32-bit ids. A missing piece is encoded and kept. When
    ``limit`` pieces are kept, they become the older generation, from which pieces in use come back, and the older ones
    before are dropped; so memory is bounded.

    With ``literal``, the names of special tokens in a text are encoded as any other characters. Without it they become
    those tokens, as in the library's own call; a text that holds one is then encoded whole.

    Two kinds of splitters are known: byte-level ones, which put a single blank before a word, and those that drop
    white space. Under any other, or where a text has white space beyond ASCII and the splitter keeps it, a text is one
    piece.
    """

    def __init__(self, path: str, limit: int = 400_000, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.limit, self.old, self.whole = limit, {}, Tokenizer.from_file(path)
        self.whole.encode_special_tokens = literal
        added = [] if literal else list(self.whole.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(sorted(re.escape(t.content) for t in added)).encode()) if added else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
            self.kind = "byte"
        elif norm and {x["type"] for x in norm.get("normalizers", [])} == {"NFC", "Replace", "Lowercase"} and pre.get("type") == "Sequence":
            split = pre["pretokenizers"][0]
            if split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]:
                self.kind = "word"
        if any(t.normalized for t in added):  # found in other spellings too
            self.kind = "whole"
        letters = [*map(chr, range(65, 91)), *map(chr, range(97, 123)), *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
        shown = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in [" ", *letters]}
        self.shown, self.model = str.maketrans(shown), self.whole.model

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            word = piece.strip(WHITE).lower() if self.kind == "word" else piece
            if self.kind != "whole" and PLAIN.fullmatch(word):
                ids = [t.id for t in self.model.tokenize(word.translate(self.shown))]
            else:
                ids = self.whole.encode(piece, add_special_tokens=False).ids
            out = pack(f"<{len(ids)}I", *ids)
            if len(piece) > 256:  # not worth its place
                return out
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out

    def _cuts(self, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces of the texts ``b[bounds[i]:bounds[i + 1]]`` begin."""
        begin = np.zeros(len(b), dtype=bool)
        begin[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        if self.kind == "whole":
            return np.flatnonzero(begin)
        white = (b == 32) | ((b - np.uint8(9)) < 5)
        before, after = np.empty(len(b), dtype=bool), np.empty(len(b), dtype=bool)  # white space or the text's rim
        before[0], before[1:] = True, white[:-1]
        before[begin] = True
        after[-1], after[:-1] = True, white[1:] | begin[1:]
        cut = begin.copy()
        if self.kind == "word":
            cut |= white & ~before
        else:
            single = white & ~after
            cut |= single & ~before  # one white space between two words begins a piece
            cut[1:] |= (single & (b != 32))[:-1]  # a blank goes with the word behind it, another white space stands alone
        # a full stop or comma between a letter and white space
        stop = np.flatnonzero(((b == 46) | (b == 44)) & after & ~before)
        last, lead = b[stop - 1], b[np.maximum(stop - 2, 0)]
        plain = ((last | np.uint8(32)) - np.uint8(97)) < 26
        wide = (lead == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7)
        cut[stop[plain | wide]] = True
        if self.kind == "byte":
            rare = np.flatnonzero((b == 0xC2) | (b == 0xE1) | (b == 0xE2) | (b == 0xE3) | ((b - np.uint8(0x1C)) < 4))
            for d in np.unique(np.searchsorted(bounds, rare, side="right") - 1):
                if ODD_SPACE.search(b[bounds[d] : bounds[d + 1]].tobytes().decode()):
                    cut[bounds[d] + 1 : bounds[d + 1]] = False
        if self.special:
            found = np.array([m.start() for m in self.special.finditer(b)], dtype=np.int64)
            for d in np.unique(np.searchsorted(bounds, found, side="right") - 1):
                cut[bounds[d] + 1 : bounds[d + 1]] = False
        return np.flatnonzero(cut)

    def _stretch(self, data: pa.Buffer, bounds: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        at, to, docs = int(bounds[0]), int(bounds[-1]), len(bounds) - 1
        tail = 0 if end is None else 1
        if at == to:
            return np.full(docs * tail, end or 0, dtype=np.uint32), np.arange(docs + 1) * tail
        cuts = self._cuts(np.frombuffer(data, np.uint8)[at:to], bounds - at)
        edges = np.append(cuts, to - at).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(edges), data.slice(at, to - at)).dictionary_encode()
        found = list(map(self.__getitem__, coded.dictionary.to_pylist()))
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        piece = coded.indices.to_numpy()
        n = sizes[piece]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[piece] - (ends - n), n) + np.arange(ends[-1])]
        # pieces before each text, then ids before it
        offsets = np.append(0, ends)[np.searchsorted(cuts, bounds - at)]
        if end is None:
            return ids, offsets
        out = np.empty(len(ids) + docs, dtype=np.uint32)
        wide = offsets + np.arange(docs + 1)
        keep = np.ones(len(out), dtype=bool)
        keep[wide[1:] - 1] = False
        out[keep], out[~keep] = ids, end
        return out, wide

    def encode(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Stretches of an Arrow column of texts, null as empty: number of the first text, ids (uint32) and where each
        text's begin in them, with the total. With ``end``, that id follows each text."""
        texts = texts.cast(pa.string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] or pa.py_buffer(b"")
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + STRETCH, side="right")) - 1)
            yield (i, *self._stretch(data, bounds[i : j + 1], end))
            i = j

    def ids(self, text: str | None) -> bytes:
        """Ids of one text."""
        return b"".join(ids.astype("<u4").tobytes() for _, ids, _ in self.encode(pa.array([text], pa.string())))


def encoder(path: str) -> Encoder:
    """The encoder of the operators: ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``."""
    return per_worker(("encoder", path), lambda: Encoder(path, literal=False))
