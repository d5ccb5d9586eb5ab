import re
import zlib
from collections import Counter, defaultdict

from conftest import SCHEMA, clashing

from clipledger.llm import spelling
from clipledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, least=7, often=2, times=10, slips=31):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                c[w] += 1
    c = {w: n for w, n in c.items() if n >= often}
    by, near = defaultdict(set), defaultdict(set)
    for w in c:
        for i in range(len(w)):
            by[i, w[:i] + w[i + 1 :]].add(w)
            if (v := w[:i] + w[i + 1 :]) in c:
                near[w].add(v)
                near[v].add(w)
    for ws in by.values():
        for w in ws:
            near[w] |= ws - {w}
    form = {}
    for w, n in c.items():
        best = min(near[w], key=lambda v: (-c[v], v), default=None)
        form[w] = best if best is not None and c[best] >= times * n else None
    out = []
    for w, n in c.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), c[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query(spark):
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert rows_of(QUERIES["op12_spelling_variants"](spark, SF)) == want
    assert sum(w[1] is not None for w in want) > 50 and sum(w[4] for w in want) > 1000


def test_split_keys_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], slips=5)
    monkeypatch.setattr(spelling, "CELL", 6)
    assert rows_of(spelling.group_variants(docs, slips=5)) == want


def test_chains_ties_and_short_words(spark):
    words = Counter({"abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10, "abcdefghij": 1, "zzzzzzz": 50, "zzzzzza": 500, "zzzzzzb": 500, "aaaaaaaa": 9, "aaaaaaaaa": 90, "aaa": 5, "abcdfeg": 3, "bbbbbbbx": 1, "xbbbbbbb": 1})
    docs = spark.createDataFrame([(k, " ".join([w] * n), None, None, None) for k, (w, n) in enumerate(words.items())], SCHEMA)
    for least, often in ((7, 1), (7, 2), (3, 1), (1, 1)):
        got = spelling.group_variants(docs, least=least, often=often)
        assert rows_of(got) == brute([(r.doc_id, r.text) for r in docs.collect()], least, often, slips=None)
    roots = {r.word: r.root for r in spelling.group_variants(docs, often=1).collect()}
    assert roots["abcdefghij"] == "abcdefg" and roots["zzzzzzz"] == "zzzzzza"


def test_very_long_words(spark):
    a, b = "ab" * 20_000, "ba" * 20_000
    texts = [a, a + "c", "c" + a, a[:17] + "x" + a[18:], b, a[:30_000] + a[30_001:], a[1:], "cab" * 5]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    got = {r.word: r.n_near for r in spelling.group_variants(docs, often=1).collect()}
    near = lambda x, y: x != y and (any(x[:k] == y[:k] and x[k + 1 :] == y[k + 1 :] for k in [next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), 0)]) if len(x) == len(y) else abs(len(x) - len(y)) == 1 and any(
        lo == hi[:k] + hi[k + 1 :] for lo, hi in [sorted((x, y), key=len)] for k in [next((i for i, (p, q) in enumerate(zip(lo, hi)) if p != q), len(lo))]))
    assert got == {x: sum(near(x, y) for y in texts) for x in texts}


def test_odd_tables(odd_null, none):
    want = brute([(r.doc_id, r.text) for r in odd_null.collect()], slips=3)
    assert rows_of(spelling.group_variants(clashing(odd_null), slips=3)) == want
    assert rows_of(spelling.group_variants(none)) == []
