"""What the operators read, shuffle or compute once, and what not again."""

import numpy as np
from pyspark.sql import types as T
from test_licenses import compare
from test_topk import brute

from clipledger.llm import licenses, topk


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_licence_texts_are_read_once(docs):
    # words come from the text in one pass; what is joined and searched afterwards is its result
    assert "lower(" not in plan(licenses.scan_licenses(docs, wrapped=True))


def test_licence_filters_read_no_text_again(docs):
    rows = docs.selectExpr("doc_id AS id", "xxhash64(text) AS h", "coalesce(text, '') AS text")
    found = plan(licenses.template_matches(licenses._read(rows, licenses.TEMPLATES, 0.8), wrapped=True)).split("\n")
    words = [line for line in found if "lower(" in line]
    assert len(words) == 2 and sum(line.count("lower(") for line in words) == 2  # lines, and runs across lines
    assert not any("Filter" in line for line in words)


def test_licence_texts_far_from_all_templates_are_not_kept(spark):
    texts = ["the words of a text like any other", "released under the\nmit terms", "released under the\nmit license", "under the license", ""]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, h long, text string")
    read = {r.id: r for r in licenses._read(rows, licenses.TEMPLATES, 0.8).collect()}
    assert [read[i].text for i in range(5)] == [None, texts[1], texts[2], None, None]
    assert [[licenses.TEMPLATES[t][0] for t in read[i].near] for i in range(5)] == [[], ["mit"], ["mit"], [], []]


def test_phrases_of_words_that_stand_apart(spark):
    texts = ["by cc", "license, general: public", "rights all reserved", " cc BY cc, by", "reserved all rights reserved\n", "\n-cc by-", "public general public license license", "all rights"]
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


class Counted(np.ndarray):
    """A matrix that counts the products it is the left side of."""

    products = 0

    def __matmul__(self, other):
        Counted.products += 1
        return np.asarray(self) @ np.asarray(other)


def test_a_block_is_multiplied_with_many_queries_at_once():
    rng = np.random.default_rng(8)
    v, size = rng.integers(-9, 10, (1024, 16)).astype(np.int16), 16
    blocks = [v[i : i + size] for i in range(0, len(v), size)]
    part = topk._Part([{"part": 3, "first": i * size, "ids": list(range(i * size, (i + 1) * size)), "matrix": b.tobytes(), "width": 2, "dims": 16, "high": b.max(0).tolist(), "low": b.min(0).tolist()} for i, b in enumerate(blocks)])
    at = np.arange(0, 1024, 4)
    Counted.products = 0
    ids, score = part.run((3 << 33) + at, v[at].astype(np.int64).view(Counted), np.full(len(at), topk.NONE), 5)
    assert Counted.products <= 4 * len(blocks) + 2  # 64 blocks in rounds of 1, 4, 16 and 64
    s = v[at].astype(np.int64) @ v.T.astype(np.int64)
    s[np.arange(len(at)), at] = topk.NONE
    best = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert (ids == best).all() and (score == np.take_along_axis(s, best, axis=1)).all()


def test_blocks_below_the_score_are_left_out():
    v = np.repeat(np.arange(40, 0, -1), 4)[:, None].astype(np.int16)  # blocks of 4 equal rows, bounds descend
    blocks = [v[i : i + 4] for i in range(0, len(v), 4)]
    part = topk._Part([{"part": 0, "first": 4 * i, "ids": list(range(4 * i, 4 * i + 4)), "matrix": b.tobytes(), "width": 2, "dims": 1, "high": b[0].tolist(), "low": b[0].tolist()} for i, b in enumerate(blocks)])
    Counted.products = 0
    ids, score = part.run(np.array([1 << 33]), np.array([[2]]).view(Counted), np.array([topk.NONE]), 4)
    assert ids.tolist() == [[0, 1, 2, 3]] and score.tolist() == [[80] * 4] and Counted.products <= 3


def vectors(spark, rows):
    return topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def test_queries_are_sent_in_the_narrowest_type(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(topk, "staged", lambda df, write=topk.staged: kept.append(df.schema) or write(df))
    for top, kind in ((1.0, T.ShortType()), (2.0**10, T.IntegerType()), (2.0**30, T.LongType())):
        rows = [(i, [top if i == 7 else (i % 11 - 5) / 8, (i % 7 - 3) / 4]) for i in range(200)]
        got = sorted(tuple(r) for r in topk.top_k(topk.index(vectors(spark, rows), 16)).collect())
        assert got == brute(rows) and kept[-1]["q"].dataType == T.ArrayType(kind)


def test_sums_beside_the_limits_of_a_type(spark):
    # sums up to 2^24 and beyond, where neighbouring whole numbers are one in single precision, and beyond 2^53
    for scale in (1.99, 2.0, 2.02, 2.0**15, 2.0**19):
        rng = np.random.default_rng(9)
        rows = [(i, (np.sign(rng.normal(size=64)) * scale + rng.integers(0, 3, 64) / 256).tolist()) for i in range(150)]
        got = sorted(tuple(r) for r in topk.top_k(topk.index(vectors(spark, rows), 16)).collect())
        assert got == brute(rows)
