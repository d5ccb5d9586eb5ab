import numpy as np
from conftest import clashing
from pyspark.sql import functions as F

from clipledger.llm import langid
from clipledger.llm.queries import QUERIES, held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_language_mixture"](spark, SF).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit_languages(docs.where(~held_out("doc_id")))


def test_mixtures_are_found(spark):
    docs = {r.lang: r.text[:2000] for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 2500).collect()}
    found = langid.infer(model(spark), [docs["en"], docs["fr"], docs["en"] + docs["fr"], docs["de"][:1200] + docs["es"][:600]])
    assert [x[0] for x in found[:2]] == ["en", "fr"] and [len(x[2]) for x in found[:2]] == [1, 1]
    assert set(found[2][2]) == {"en", "fr"} and all(0.35 < p < 0.65 for p in found[2][3])
    assert found[3][2] == ["de", "es"] and 0.5 < found[3][1] < 0.8


def test_odd_tables(spark, odd_null, none):
    m = model(spark)
    rows = langid.identify(clashing(odd_null), m).collect()
    assert len(rows) == 14
    for r in rows:
        if r.id in (3, 4, 5):
            assert (r.lang_pred, r.score, r.languages) == ("und", 0.0, [])
        if r.id in (1, 9, 8):
            assert r.lang_pred in m.languages and r.score > 0
    assert langid.identify(none, m).collect() == []
    nothing = langid.fit_languages(none)
    assert nothing.languages == [] and {r.lang_pred for r in langid.identify(odd_null, nothing).collect()} == {"und"}


def test_texts_do_not_depend_on_their_batch(spark):
    m = model(spark)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [None, "", "1 2 3", "é"]
    assert langid.infer(m, texts) == [langid.infer(m, [t])[0] for t in texts] or all(
        a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 for a, b in zip(langid.infer(m, texts), [langid.infer(m, [t])[0] for t in texts])
    )


def test_fit_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = langid.fit_languages(docs, per_language=3)
    assert small.languages == ["de", "en", "es", "fr"]
    again = langid.fit_languages(docs.repartition(9), per_language=3)
    assert np.array_equal(small.logp, again.logp)


def plain_buckets(text):
    """Trigrams of letters and single blanks, hashed, one by one."""
    letters = [ord(c.lower()[0]) if c.isalpha() else 0 for c in f" {text} "]
    kept = [c for at, c in enumerate(letters) if at == 0 or c or letters[at - 1]]
    out = []
    for x, y, z in zip(kept, kept[1:], kept[2:]):
        h = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF
        out.append((((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS))
    return out


def plain_mixture(model, text, most=3, rounds=8, cost=4.0, least=0.02):
    """Proportions by language: expectation-maximisation of one text in double precision."""
    p = np.exp(np.array([model.logp[g] for g in plain_buckets(text)], dtype=np.float64))
    total = lambda mix: sum(np.log(p @ mix))
    mix = np.eye(p.shape[1])[np.log(p).sum(axis=0).argmax()]
    score = total(mix)
    while np.count_nonzero(mix) < most:
        rise = np.where(mix > 0, 0, (p / (p @ mix)[:, None]).mean(axis=0))
        new = rise.argmax()
        if rise[new] <= 1:
            break
        trial = 0.8 * mix + 0.2 * np.eye(len(mix))[new]
        for _ in range(rounds):
            parts = p * trial
            trial = (parts / parts.sum(axis=1, keepdims=True)).mean(axis=0)
        if total(trial) - score <= cost / 2 * np.log(len(p)) or trial[new] < least:
            break
        mix, score = trial, total(trial)
    return {lang: share for lang, share in zip(model.languages, mix) if share > 0}


def test_mixtures_against_a_plain_computation(spark):
    m = model(spark)
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect() if r.text]
    texts = [t[:1500] for t in rows] + [a[:700] + " " + b[:400] for a, b in zip(rows, rows[7:])] + ["é", "A b. C", "Straße über 12 naïve ÉCOLE"]
    for text, (lang, score, langs, shares) in zip(texts, langid.infer(m, texts)):
        want = plain_mixture(m, text)
        assert set(langs) == set(want) and lang == max(want, key=want.get), text[:80]
        assert abs(score - want[lang]) < 1e-3 and all(abs(s - want[x]) < 1e-3 for x, s in zip(langs, shares))
