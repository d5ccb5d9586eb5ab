import hashlib
import random

import numpy as np
import pytest
from conftest import clashing

from clipledger.llm.pieces import Pieces, encode_decode
from clipledger.llm.queries import QUERIES, tokenizer_path

SF, PATH = "/root/testdata/sf0.01", tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


def same(model, library, texts):
    want = library.encode(texts, add_eos=True)
    ids, offsets = model.encode(texts, 2)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert model.decode(ids, offsets).to_pylist() == library.decode(want)


def test_query_gives_the_library_s_ids(spark, library):
    got = {r.doc_id: r for r in QUERIES["op13_sentence_pieces"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        ids = library.encode(r.text or "", add_eos=True)
        assert got[r.doc_id][1:] == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))


def test_random_texts(model, library):
    r = random.Random(5)
    parts = ["a", "b", "ab", "th", "e", " ", "  ", "\n", "▁", "é", "中", "\U0001f600", "\x00", "<s>", "</s>", "<0x0A>", "=", "==", "----", "\t", "　", "ÿ", "000", "aaaa", "the", " the", "ing", "�"]
    same(model, library, ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(2000)])
    same(model, library, ["".join(r.choice("aeinrst") for _ in range(r.randint(0, 300))) for _ in range(1000)])
    same(model, library, ["".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(1000)])


def test_long_units_and_repeats(model, library):
    r = random.Random(6)
    same(model, library, ["a" * 5000, "=" * 3001, " " * 4097, "ab" * 3000, "aba" * 1000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20_000))])


def test_merges_wait_for_pairs_that_come_first(model):
    """Under a model in which a merge makes a better pair than the one it came from, the order of single merges."""
    toy = Pieces.__new__(Pieces)
    dict.__init__(toy)
    toy.kinds = np.full(8, 1)
    toy.chars, toy.char_symbols = np.array([97, 98, 99]), np.array([0, 1, 2])
    toy.base = 8
    # ab: 3 with rank 5; cab: 4 with rank 1, from c + ab alone; abc: 5 with rank 2, from ab + c; bc: 6, rank 9
    pairs = {(0, 1): (5, 3), (2, 3): (1, 4), (3, 2): (2, 5), (1, 2): (9, 6)}
    toy.pair_keys = np.array(sorted(a * 8 + b for a, b in pairs))
    toy.pair_ranks, toy.pair_ids = (np.array([pairs[divmod(int(k), 8)][j] for k in toy.pair_keys], dtype=np.int32) for j in (0, 1))

    def one_by_one(text):
        s = [toy.char_symbols["abc".index(c)] for c in text]
        while True:
            due = min(((pairs[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in pairs), default=None)
            if due is None:
                return s
            s[due[1] : due[1] + 2] = [pairs[s[due[1]], s[due[1] + 1]][1]]

    r = random.Random(7)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(500)] + ["ab" * 50, "abc" * 40, "cab" * 40]
    assert [np.frombuffer(x, "<i4").tolist() for x in toy.units(texts)] == [list(map(int, one_by_one(t))) for t in texts]


def test_decoding_any_ids(model, library):
    r = random.Random(8)
    rows = [[r.choice([r.randint(0, 300), r.randint(0, 31_999)]) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    ids, offsets = np.array([x for q in rows for x in q], np.int32), np.cumsum([0, *map(len, rows)])
    assert model.decode(ids, offsets).to_pylist() == [library.decode(q) for q in rows]


def test_a_small_store_gives_the_same(library):
    texts = ["one two three two one", "three four five one", "six"] * 3
    small = Pieces(PATH, limit=2)
    for t in texts:
        same(small, library, [t])


def test_odd_tables(odd_null, none, library):
    rows = encode_decode(clashing(odd_null), PATH).collect()
    want = [(r.doc_id, tuple(library.encode(r.text or "", add_eos=True)), r.text or "") for r in odd_null.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.id, tuple(r.ids), r.decoded) for r in rows), key=key) == sorted(want, key=key)
    assert encode_decode(none, PATH).collect() == []
