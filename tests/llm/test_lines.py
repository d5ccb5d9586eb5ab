import random
import re
import time

from conftest import clashing

from clipledger.llm import linedup, substrings


def norm(line):
    return re.sub("[\x20\x09-\x0d]+", " ", line).strip(" ").lower()


def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def brute_lines(rows, min_chars=20):
    """Documents with distinct ids only."""
    seen, out = [], {}
    for i, text in sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        keep, gone = [], []
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            x = norm(line)
            if x and any(x == y or (min(len(x), len(y)) >= min_chars and within_one(x, y)) for y in seen):
                gone.append(at)
            else:
                keep.append(line)
            if x:
                seen.append(x)
        out[i] = (None if text is None else "\n".join(keep), gone)
    return out


def lines_of(df, **options):
    return {r.doc_id: (r.text, r.removed) for r in linedup.drop_repeated_lines(df, **options).collect()}


def test_variants_against_brute_force(spark):
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 60))) for _ in range(12)] + ["a" * 30, "ab" * 20]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            x = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "a", "é"])
            lines.append("".join(x) + rng.choice(["", " ", "\t"]))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert lines_of(df) == brute_lines(rows)


def test_copies_of_any_length(spark):
    rows = [(1, "ok\nAll rights reserved\n\nx"), (2, "all rights  reserved\n\nOK\nAll rights reservee"), (3, "x\ny\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines_of(df) == brute_lines(rows)
    assert lines_of(df)[2] == ("\nAll rights reservee", [0, 2]) and lines_of(df)[3][1] == [0]


def test_long_lines_cost_their_length(spark):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ij\u00e9\U0001f600") for _ in range(200_000)).strip()
    other = line[:120_000] + "#" + line[120_001:]
    shorter = line[:77] + line[78:]
    df = spark.createDataFrame([(1, line), (2, other), (3, shorter), (4, line[1000:] + line[:1000])], "doc_id long, text string")
    begun = time.monotonic()
    assert {i: gone for i, (_, gone) in lines_of(df).items()} == {1: [], 2: [0], 3: [0], 4: []}
    assert time.monotonic() - begun < 60


def test_odd_tables(odd_null, none, spark):
    out = linedup.drop_repeated_lines(clashing(odd_null)).collect()
    assert len(out) == 14 and linedup.drop_repeated_lines(none).collect() == []
    by = {(r.doc_id, r.n_chars): r for r in out}
    assert by[(1, 3)].n_removed == 0 and by[(2, 3)].removed == [0, 1] and by[(2, 3)].text == ""
    assert by[(9, 3)].text == "" and by[(3, None)].text is None and by[(None, None)].n_removed == 0
    assert by[(-5, 150_000)].n_removed == 0 and by[(5, 5)].text == " \n\t \n"
    assert [r.n_removed for r in out if r.doc_id == 8] == [0, 0]  # rows equal in id and text are one document


def test_only_functions_of_the_engine(docs):
    plan = linedup.drop_repeated_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|CartesianProduct|NestedLoop", re.sub("Scan ExistingRDD", "", plan))


def brute_spans(rows, min_words=5):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        found = [(m.start(), -m.end(), level, m.group()) for level, name in enumerate(("line", "sentence")) for m in substrings.UNITS[name].finditer(text or "")]
        cuts = []
        for start, end, level, unit in sorted(found, key=lambda f: (f[0], f[1], f[2])):
            w = unit.lower().split()
            if len(w) < min_words:
                continue
            key = (level, " ".join(w))
            if key in seen:
                cuts.append((start, -end))
            seen.add(key)
        kept = "".join(c for k, c in enumerate(text or "") if not any(s <= k < e for s, e in cuts))
        out[i] = (kept, sorted(set(cuts), key=lambda c: (c[0], -c[1])))
    return out


def test_repeats_against_brute_force(docs, spark):
    passage = "First comes a sentence of nine words in all. Then one more that is long enough to count. And a third one to end the shared passage."
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(900, f"Own beginning without a stop {passage} Own ending."), (901, f"Quite another one, cut short {passage}\nlast line"), (902, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_spans(rows)
    for r in substrings.remove_repeats(df).collect():
        assert (r.text, [(s.start, s.end) for s in r.removed]) == want[r.id], r.id
        text = dict(rows)[r.id]
        assert r.n_chars == len(text) and r.n_removed == len(text) - len(r.text)
        assert all(s.first_id <= r.id for s in r.removed)
    assert "Then one more" in want[900][0] and "Then one more" not in want[901][0] and "Then one more" not in want[902][0]


def test_repeats_in_odd_tables(odd_null, none):
    rows = substrings.remove_repeats(clashing(odd_null)).collect()
    assert len(rows) == 14 and substrings.remove_repeats(none).collect() == []
    by = {(r.id, r.n_chars): r for r in rows}
    assert by[(3, 0)].text == "" and by[(-5, 150_000)].n_removed == 0
    assert next(r for r in rows if r.id == 9).text == "" and next(r for r in rows if r.id == 1).n_removed == 0
