import random
from itertools import combinations

import numpy as np
import pytest
from conftest import clashing
from xxhash import xxh64_intdigest

from clipledger.llm import simhash


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, bits=2):
    up = {p: p for p in prints}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= bits:
            up[root(b)] = root(a)
    out = {}
    for p in prints:
        out.setdefault(root(p), set()).add(p)
    return sorted(map(sorted, out.values()))


def signed(p):
    return p - (1 << 64) if p >= 1 << 63 else p


def spark_classes(spark, prints, **options):
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long").repartition(4)
    edges = simhash.links(df, **options)
    roots = {r.node: r.root for r in simhash.classes(edges).collect()}
    out = {}
    for p in prints:
        out.setdefault(roots.get(signed(p), signed(p)), set()).add(p)
    return sorted(map(sorted, out.values()))


def test_codes_are_perfect_covers():
    for bits, poly, radius in simhash.CODES:
        b = simhash.Block(bits, poly, radius, 1)
        near = [(b.cost[s:e] == 0).sum() for s, e in zip(b.starts, b.starts[1:])]
        assert set(near) == {1}
    assert sum(c[0] for c in simhash.CODES) == 64


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_equal_all_pairs(spark, limit):
    """limit 3: nearly all anchors are crowded and go to the trivial code."""
    rng = random.Random(1)
    prints = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(8):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {1 << i for i in range(0, 64, 3)}  # a class around 0, of which any two are two bits apart
    assert spark_classes(spark, prints, limit=limit) == brute_classes(prints)


def test_every_near_pair_shares_an_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    for flips in ((0,), (1,), (5, 40), (22, 23), (63, 61), (46, 47), (3, 4)):
        y = x.copy()
        for f in flips:
            y ^= np.uint64(1 << f)
        a, b = simhash.cover(x, 1), simhash.cover(y, 1)
        got = {i: set(a[1][a[0] == i]) & set(b[1][b[0] == i]) for i in range(len(x))}
        assert all(got.values())


def test_whole_operator(spark, docs):
    rows = docs.collect()
    want_prints = {r.doc_id: brute_print(r.text) for r in rows}
    least = {}
    for c in brute_classes(set(want_prints.values())):
        for p in c:
            least[p] = min(i for i, q in want_prints.items() if q in c)
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint == signed(want_prints[r.id])
        assert r.component_id == least[want_prints[r.id]]


def test_odd_tables(odd_null, none):
    rows = simhash.near_duplicates(clashing(odd_null)).collect()
    assert len(rows) == 14 and simhash.near_duplicates(none).collect() == []
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert all(r.fingerprint == 0 and r.component_id == 3 for i in (3, 4, 5) for r in by[i])
    assert {r.component_id for r in by[9]} == {1} and len(by[8]) == 2
    assert {r.component_id for r in by[None] if r.fingerprint == 0} == {3}
