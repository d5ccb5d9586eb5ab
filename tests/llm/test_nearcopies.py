import random

from conftest import clashing

import corpus_pipeline
from clipledger.llm.nearcopies import near_copies


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w)))))


def brute(rows):
    """Smallest id of each id's class, by comparing all pairs."""
    sets, up = {}, {}
    for i, text in rows:
        sets.setdefault(grams(text), []).append(i)
    kinds = list(sets)
    up = list(range(len(kinds)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            both = len(kinds[a] & kinds[b])
            if both and both >= 0.8 * (len(kinds[a]) + len(kinds[b]) - both) - 1e-9:
                up[root(a)] = root(b)
    out, low = {}, {}
    for k, s in enumerate(kinds):
        low[root(k)] = min(low.get(root(k), 1 << 60), *sets[s])
    for k, s in enumerate(kinds):
        out |= {i: low[root(k)] for i in sets[s]}
    return out


def varied():
    rng, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(x)))
    return rows + [(len(rows), None), (len(rows) + 1, " \n")]


def test_equals_brute_force(spark):
    rows = varied()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in near_copies(clashing(df)).collect()}
    assert got == brute(rows) and len(set(got.values())) < len(rows) - 20


def test_simhash_links_join_near_fingerprints(spark):
    from pyspark.sql import functions as F

    from clipledger.llm import nearcopies, simhash

    rng, words = random.Random(7), [f"w{i}" for i in range(900)]
    texts = [" ".join("x" if i == at else w for i, w in enumerate(words)) for at in rng.sample(range(900), 40)]
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    prints = {r.id: r.fingerprint for r in simhash.fingerprints(df, "node", "text").collect()}
    up = {i: i for i in prints}
    for _ in prints:
        up = {i: min(up[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= nearcopies.BITS) for i in prints}
    edges = nearcopies._linked(df, 42)
    got = {i: i for i in prints} | {r.node: r.root for r in simhash.classes(edges).collect()}
    assert got == up and edges.where(F.col("src") >= F.col("dst")).isEmpty() and len(set(up.values())) < 60


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.id: r.component_id for r in near_copies(df).collect()} == brute(rows)


def test_stage_drops_copies_with_changed_words(spark):
    """Five of 120 words changed far apart leave 91 of 141 shingles, three leave 101 of 131 and two 106 of 126."""
    base = [f"word{i}" for i in range(120)]
    change = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(base))
    rows = [(1, change()), (2, change(20, 60)), (3, change(10, 30, 50, 70, 90)), (4, change(80, 100, 110))]
    df = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, "").collect())
    assert kept == sorted(set(brute(rows).values())) == [1, 3, 4]


def test_odd_tables(odd_null, none):
    rows = near_copies(odd_null).collect()
    assert len(rows) == 14 and near_copies(none).collect() == []
    assert all(r.component_id == 3 for r in rows if r.id in (3, 4, 5))


def test_large_group_around_one_text_meets_it(spark, monkeypatch):
    """Copies with changed words of their own are alike to the text in the middle, seldom to each other."""
    from clipledger.llm import nearcopies

    rng, base = random.Random(11), [f"w{i}" for i in range(140)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        x = list(base)
        for at in rng.sample(range(140), 3):
            x[at] = f"own{i}-{at}"
        rows.append((i, " ".join(x)))
    met, similar = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, *rest: met.append(pairs.count()) or similar(pairs, *rest))
    got = {r.id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(met) < 4 * len(rows)  # not in proportion to all pairs
