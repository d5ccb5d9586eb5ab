import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from conftest import clashing
from tokenizers import Tokenizer

from clipledger.llm.packing import MERGE_FLAG, Windows, pack
from clipledger.llm.queries import tokenizer_path
from clipledger.llm.tokens import Encoder

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


@cache
def tokenizer(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t


def plain(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


TRICKY = ["It's  a 'test'.\n\n  x,y. z...", "a.b, c.", " lead", "trail \n", "é́. à,x ÀÉ. ß", "don't. 'S 'll x  y\x1cz", "<|endoftext|> <|startoftext|>", "1.5, 2. ½² x_y", "\t\ttab\r\nwin ", "naïve...end. \n\n\nN", "İK ΑΣ. ﬁ"]


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_word_by_word_ids_are_those_of_whole_texts(docs, name):
    enc = Encoder(tokenizer_path(name), limit=50)
    for text in TRICKY + [r.text for r in docs.limit(40).collect()]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == plain(name, text), text[:80]
    assert len(enc) <= 51 and enc.ids(None) == b""


def check(rows, docs, size, sequences_with_room):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        by_doc[(r.id, r.doc_tokens)].append(r)
        by_seq[r.sequence_id].append(r)
    got = sorted((k[0] is None, k[0] or 0, n, b"") for k, n in ((k, sum(x.length for x in v)) for k, v in by_doc.items()))
    want = defaultdict(int)
    for d in docs:
        n = len(plain(WORDS, d.text)) + 1
        want[(d.doc_id, n)] += n
    assert got == sorted((k[0] is None, k[0] or 0, n, b"") for k, n in want.items())
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    assert sum(sum(r.length for r in seq) < size for seq in by_seq.values()) <= sequences_with_room
    return by_doc


def test_pieces_tile_documents_and_sequences(docs):
    rows = pack(docs.repartition(5), tokenizer_path(WORDS), size=256, windows=4).collect()
    by_doc = check(rows, docs.collect(), 256, 1)
    texts = {d.doc_id: d.text for d in docs.collect()}
    for (doc, total), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ids = b"".join(p.ids for p in pieces)
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert np.frombuffer(ids, "<u4").tolist() == plain(WORDS, texts[doc]) + [1]
        assert total == len(ids) // 4


def test_digest_of_the_query(spark):
    from clipledger.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op1_pack_sequences"](spark, "/root/testdata/sf0.001").collect():
        ids = np.array((plain(WORDS, texts[r.doc_id]) + [1])[r.start : r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_odd_tables(odd_null, none):
    check(pack(clashing(odd_null), tokenizer_path(WORDS)).collect(), odd_null.collect(), 2048, 1)
    assert pack(none, tokenizer_path(WORDS)).collect() == []


def test_best_fit_then_fullest():
    w = Windows(10, 2, 0)
    ids = lambda n: b"\1\0\0\0" * n
    w.add(1, 0, ids(6), 6)
    w.add(2, 0, ids(7), 7)
    w.add(3, 0, ids(3), 3)  # fills the second window, the fuller one
    assert [x[5] for x in w.out] == [0, 0] and [x[0] for x in w.out] == [2, 3]
    w.add(4, 0, ids(8), 8)
    w.add(5, 0, ids(5), 5)  # fits nowhere: tops up the fullest (8), the rest goes on
    assert [(x[0], x[2], x[6]) for x in w.out[2:]] == [(4, 8, 0), (5, 2, 8)]
    assert sorted(x[0] for x in w.open) == [9]
    w.close()
    assert sum(x[2] for x in w.out) == 29 and MERGE_FLAG > 0


SPECIAL = ["one<|endoftext|> two", "<|endoftext|>", "a  <|endoftext|>b, c. <|startoftext|>\n\nd", "<|EndOfText|> <|endoftext| >", "é́<|endoftext|>́ ", " <|endoftext|> <|endoftext|> \t"]


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_special_tokens_as_in_the_default_call(docs, name):
    from clipledger.llm.tokens import encoder

    enc, default = encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    texts = [*SPECIAL, *TRICKY, *[f"{r.text} <|endoftext|>{r.text}" for r in docs.limit(10).collect()]]
    want = [default.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == want
    import pyarrow as pa

    (_, ids, cuts), = enc.encode(pa.array(texts), 0)
    assert [ids[a : b - 1].tolist() for a, b in zip(cuts, cuts[1:])] == want


def test_packed_special_tokens(spark):
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    default = Tokenizer.from_file(tokenizer_path(WORDS))
    got = {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in pack(df, tokenizer_path(WORDS)).collect()}
    assert got == {i: default.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(SPECIAL)}
