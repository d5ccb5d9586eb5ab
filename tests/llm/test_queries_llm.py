"""Queries against their SQL, and the pipeline stage by stage."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import compare, connect  # noqa: E402
from conftest import clashing  # noqa: E402
from test_nearcopies import brute as brute_copies  # noqa: E402

import corpus_pipeline  # noqa: E402
from clipledger.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF, QUERIES, ORACLES)
    assert ok, note


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    from __spark_entry__ import queries

    assert {*QUERIES, "pipeline"} <= set(queries())


@pytest.fixture(scope="module")
def staged(spark):
    """What each stage returns on the whole table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_stages_keep_columns_and_clean_documents(staged):
    for docs in staged[:-1]:
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = staged[0].toPandas(), staged[1].toPandas()
    assert len(after) > 0.98 * len(before)  # every document has letters, and few are mixed
    assert set(staged[1].toPandas().doc_id) == set(staged[2].toPandas().doc_id)


def test_one_document_of_each_group_stays(staged):
    before, after = staged[2].toPandas(), staged[3].toPandas()
    want = set(brute_copies(list(zip(before.doc_id, before.text))).values())
    assert set(after.doc_id) == want and len(after) == len(want) < len(before)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_an_id(spark):
    """Each is judged and taken by its own text."""
    one = "the same long line of words that two documents share from its start to its end"
    docs = spark.createDataFrame([(1, one, "en", "a", 1), (2, one, "en", "a", 1), (2, "quite another text about something else altogether", "en", "a", 1), (3, "twice here", "en", "a", 1), (3, "twice here", "en", "a", 1)], DOCS)
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, docs, "").collect())
    assert kept == [(1, one), (2, "quite another text about something else altogether"), (3, "twice here")]
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "a", 1), (1, "one", "en", "a", 1), (2, " ".join(["w"] * 40), "en", "b", 1)], DOCS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, clashing(docs), "").collect())
    assert got[1, "one"] <= 3 and got[1, "a b c d e f g"] <= 3


def test_without_labels_documents_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 1), (2, "12 34 !", None, "a", 1), (3, None, None, "a", 1), (4, "слова", None, "a", 1)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.identify_languages(spark, docs, "").collect()) == [1, 4]


def test_stages_take_odd_tables(spark, odd_null, none):
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, clashing(odd_null), "").collect()
        assert rows, name
        assert stage(spark, none, "").collect() == [], name


def test_mix_and_pack(spark, staged):
    from clipledger.llm.mixing import mix

    taken = {r.id: r.taken for r in mix(staged[3]).collect()}
    got = Counter()
    texts = {r.doc_id: r.text for r in staged[3].collect()}
    for r in staged[4].collect():
        got[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text.rstrip()) or r.text == texts[r.doc_id]
    assert got == Counter({i: n for i, n in taken.items() if n})
    rows = staged[5].collect()
    assert Counter(r.doc_id for r in staged[4].collect()) == Counter(r.doc_id for r in rows if r.start == 0)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and sum(2048 - n for n in fill.values()) < 2048


def test_run_gives_the_same(spark, staged):
    tokens = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.collect() if r.start == 0)
    assert tokens(corpus_pipeline.run(spark, SF)) == tokens(staged[5])


def test_odd_tables(spark, odd_null, none, tmp_path):
    for name, table in (("odd", odd_null), ("none", none)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(rows) == (name == "odd")
