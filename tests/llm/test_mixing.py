import hashlib
import re
from collections import defaultdict

from conftest import clashing

from clipledger.llm.mixing import mix


def brute(rows, weights=(5, 2, 1), epochs=3, seed=7):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped = {s for s in order if total[s] == 0}
    while True:
        rest, left = sum(weight[s] for s in order if s not in clamped), sum(total.values()) - sum(epochs * total[s] for s in clamped)
        target = {s: float(epochs * total[s]) if s in clamped else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in clamped and target[s] > epochs * total[s]}
        if not over:
            break
        clamped |= over
    out = []
    for s in order:
        whole = int(target[s]) // total[s] if total[s] else 0
        quota = int(target[s]) - whole * total[s]
        some = [(hashlib.md5(f"{seed}-{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, n) for r, n in zip(rows, size) if r[3] == s]
        for _, known, i, n in sorted(some):
            extra = max(0, min(n, quota))
            quota -= extra
            out.append((i if known else None, s, n, total[s], target[s], n * whole + extra))
    return sorted(out, key=str)


def test_odd_tables(odd_null, none):
    got = sorted(((r.id, r.source, r.size, r.source_size, r.target, r.taken) for r in mix(clashing(odd_null)).collect()), key=str)
    assert got == brute([tuple(r) for r in odd_null.collect()])
    assert mix(none).collect() == []


def test_targets_are_met_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = mix(docs).collect()
    assert sorted(a) == sorted(mix(docs.repartition(7)).collect())
    taken = defaultdict(int)
    for r in a:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[r.source] - r.target) < 1 for r in a)


def test_all_documents_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mix(df).collect()} == {(0, 0.0)}
