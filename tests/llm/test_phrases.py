import hashlib

import numpy as np
from conftest import clashing

from clipledger.llm import phrases
from clipledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (i, t, *_), (_, u, *_) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        yield i, len(t), t[: len(t) - half] + u[:half]


def test_edited_texts_and_likeness(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, hashlib.sha256(e.encode()).hexdigest(), e) for i, n, e in brute(rows)}
    got = QUERIES["op6_phrase_fingerprints"](spark, SF).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        own, new = phrases.sketches([texts[r.doc_id], want[r.doc_id][2]])
        assert r.fingerprint == phrases.text_of(own) and r.edited_fingerprint == phrases.text_of(new)
        assert abs(r.near_edited - phrases.likeness(own, new)) < 1e-12 and 0 <= r.near_next <= 1
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.2 > 0.05 > np.median([r.near_next for r in long])
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_equal_stretches_share_interior_names_at_any_offset():
    rng = np.random.default_rng(3)
    part = "".join(rng.choice(list("abcdefgh "), 4000))
    a, b = phrases.sketches([part, "".join(rng.choice(list("abcdefgh "), 137)) + part], size=10**6)
    assert len(np.intersect1d(a, b)) / len(a) > 0.9
    a, c = phrases.sketches([part, "".join(rng.choice(list("abcdefgh "), 4000))], size=10**6)
    assert len(np.intersect1d(a, c)) / len(a) < 0.05


def test_batches_do_not_change_fingerprints():
    texts = ["", "a", "aaaa", "ab" * 500, "x" * 10_000, "the cat sat on the mat. " * 9, "éü" * 77]
    alone = [phrases.text_of(phrases.sketches([t])[0]) for t in texts]
    assert alone == [phrases.text_of(s) for s in phrases.sketches(texts)]
    assert alone[0] == "" and all(alone[1:])


def test_odd_tables(odd_null, none, spark):
    rows = phrases.compare_with_next(clashing(odd_null)).collect()
    want = sorted((i is None, i or 0, n, e) for i, n, e in brute([(r.doc_id, r.text) for r in odd_null.collect()]))
    assert sorted((r.id is None, r.id or 0, r.n_chars, r.edited_text) for r in rows) == want
    assert phrases.compare_with_next(none).collect() == []
    one = phrases.compare_with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [(r.edited_text, r.near_next) for r in one] == [("abab", 1.0)]
    assert {r.fingerprint for r in phrases.document_fingerprints(odd_null).collect() if r.id in (3, 4)} == {""}


FULL = 2**64 - 1


def plain_mix(x):
    x = (x ^ x >> 30) * int(phrases.B) & FULL
    x = (x ^ x >> 27) * int(phrases.C) & FULL
    return x ^ x >> 31


def plain_toss(names):
    """Of each name: lowest bit that differs from the left neighbour's, twice, plus that bit (the first: bit 0)."""
    out = [names[0] & 1]
    for left, own in zip(names, names[1:]):
        at = ((left ^ own) & -(left ^ own)).bit_length() - 1
        out.append(2 * at + (own >> at & 1) if left != own else 0)
    return out


def plain_level(names):
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [plain_mix(x + k * int(phrases.A) & FULL) for x, k in runs]
    label = plain_toss(plain_toss(names))
    blocks = []
    for i, x in enumerate(names):
        if i == 0 or (i < len(names) - 1 and label[i - 1] < label[i] >= label[i + 1]):
            blocks.append([])
        blocks[-1].append(x)
    return [plain_mix(sum(plain_mix(x + (at + 1) * int(phrases.A) & FULL) for at, x in enumerate(b)) & FULL) for b in blocks]


def plain_sketch(text, size=64):
    names, level, found = [plain_mix(ord(c) + int(phrases.A) & FULL) for c in text], 0, set()
    while names:
        names, level = plain_level(names), level + 1
        if level >= 2 or len(names) == 1:
            found |= {plain_mix(x + level * int(phrases.C) & FULL) >> 32 for x in names}
        if len(names) == 1:
            break
    return sorted(found)[:size]


def test_parse_against_a_plain_one(docs):
    texts = [r.text for r in docs.limit(60).collect() if r.text]
    texts += ["", "a", "ab", "aaaa", "aab", "ab" * 300, "x" * 5000, "aaabbbaaabbb" * 40, "\U00010400\U0001F600 éàü ß 中文"]
    assert [s.tolist() for s in phrases.sketches(texts)] == [plain_sketch(t) for t in texts]
