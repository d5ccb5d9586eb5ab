import numpy as np
import pytest
from conftest import clashing
from hypothesis import given, settings
from hypothesis import strategies as st
from test_packing import BYTES, plain

from clipledger.llm.queries import tokenizer_path
from clipledger.llm.tokenfiles import EliasFano, elias_fano, read_tokens, token_folder, write_tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=2000), st.integers(0, 10**9))
def test_elias_fano_round_trip(steps, extra):
    v = np.cumsum(np.array([0] + steps, dtype=np.int64))
    e = EliasFano(elias_fano(v, int(v[-1]) + extra))
    assert e.values(0, len(v)).tolist() == v.tolist()
    for i in {0, len(v) // 2, len(v) - 1}:
        assert e.select(i) == v[i]
    assert e.values(len(v) // 3, len(v) // 2).tolist() == v[len(v) // 3 : len(v) // 2].tolist()


def test_space_is_near_minimal():
    v = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(elias_fano(v, int(v[-1]))) * 8 / len(v) < 2.2 + np.log2(v[-1] / len(v))


def round_trip(df):
    folder = token_folder(df.sparkSession)
    manifest = write_tokens(df, tokenizer_path(BYTES), folder)
    return read_tokens(manifest, folder).collect()


def test_files_hold_all_ids_in_order(docs):
    rows = sorted(round_trip(docs.repartition(4)), key=lambda r: r.id)
    at = 0
    for r, d in zip(rows, sorted(docs.collect(), key=lambda d: d.doc_id), strict=True):
        want = plain(BYTES, d.text) + [0]
        assert (r.id, r.start, r.n_tokens) == (d.doc_id, at, len(want))
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)


def test_odd_tables(odd, odd_null, none):
    rows = sorted(round_trip(clashing(odd)), key=lambda r: r.start)
    assert [r.id for r in rows] == sorted(r.doc_id for r in odd.collect())
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert {r.n_tokens for r in rows if r.id in (3, 4)} == {1}
    assert round_trip(none) == []
    with pytest.raises(Exception, match="null id"):
        round_trip(odd_null)


@pytest.mark.parametrize("ids", ["some", "all"])
def test_null_ids_in_the_query(spark, odd_null, tmp_path, ids):
    """They come first, in the order of their texts, and the query does not fail."""
    import zlib

    from clipledger.llm.queries import QUERIES

    df = odd_null if ids == "some" else odd_null.withColumn("doc_id", odd_null.doc_id * None)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(QUERIES["op4_token_files"](spark, str(tmp_path)).collect(), key=lambda r: r.start)
    at = 0
    docs = sorted(df.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text is not None, d.text or ""))
    for r, d in zip(rows, docs, strict=True):
        want = plain(BYTES, d.text) + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
