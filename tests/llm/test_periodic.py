import hashlib
import random
import zlib

import pytest
from conftest import clashing

from clipledger.llm.periodic import find_runs, lyndon, runs_of
from clipledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_runs(w, least, exponent):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and not any(q % d == 0 and all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    w = (text or "").split("\n")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = brute_runs(w, 6, 4)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {x for s, m, q in runs for x in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_lyndon_arrays():
    r = random.Random(0)
    is_lyndon = lambda s: all(s < s[i:] for i in range(1, len(s)))
    brute = lambda s: [max(k for k in range(1, len(s) - i + 1) if is_lyndon(s[i : i + k])) for i in range(len(s))]
    for _ in range(1500):
        s = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 14))]
        assert lyndon(s) == brute(s) and lyndon(s, True) == brute([-x for x in s])


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (6, 3), (10, 4)])
def test_runs(least, exponent):
    r, texts = random.Random(least), [[], [b"a"] * 5, [b"a"] * 6, [b"a"] * 7]
    for _ in range(1500):
        s = []
        while len(s) < r.randint(0, 60):
            if r.random() < 0.5:
                s += [r.randint(0, r.choice([1, 3, 30])) for _ in range(r.randint(1, 6))]
            else:
                u = [r.randint(0, 3) for _ in range(r.randint(1, 5))]
                s += u * r.randint(2, 7) + u[: r.randint(0, len(u))]
        texts.append([b"%d" % x for x in s])
    assert [[tuple(x) for x in g.tolist()] for g in runs_of(texts, least, exponent)] == [brute_runs(t, least, exponent) for t in texts]


def test_query(spark):
    want = sorted(brute_row(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 20_000)
    ids = {w[0] for w in want}
    got = QUERIES["op11_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sorted(tuple(r) for r in rows if r.doc_id in ids) == want and sum(w[1] > 0 for w in want) > 50


def test_long_texts_cost_in_proportion():
    (one,), (many,) = runs_of([[b"a", b"b", b"c"] * 100_000], 6, 4), runs_of([[b"%d" % (k % 977) for k in range(100_000)]], 6, 4)
    assert one.tolist() == [[0, 300_000, 3]] and many.tolist() == [[0, 100_000, 977]]


def test_odd_tables(spark, odd_null, none, tmp_path):
    rows = find_runs(clashing(odd_null)).collect()
    assert len(rows) == odd_null.count()
    by = {(r.id, r.n_words): r for r in rows}
    assert [tuple(x) for x in by[-5, 30_000].runs] == [(0, 30_000, 1)] and by[-5, 30_000].collapsed == "word"
    assert all(r.runs == [] and r.collapsed == "" for r in rows if r.n_words == 0)
    assert find_runs(none).collect() == []
    odd_null.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want = [brute_row(r.doc_id, r.text) for r in odd_null.where("doc_id IS NOT NULL AND doc_id > 0").collect()]
    assert sorted(tuple(r) for r in got if (r.doc_id or 0) > 0) == sorted(want)
    assert len([r for r in got if r.doc_id is None]) == 2  # no id: the text stays as it is
