import re

from conftest import clashing

from clipledger.llm.licenses import PHRASES, TEMPLATES, scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text, threshold=0.8):
    w = WORD.findall(lower(text))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base, labels, best = {x for _, x in places}, set(), 0.0
    for line in (text or "").split("\n"):
        have = set(WORD.findall(lower(line)))
        for label, t in TEMPLATES:
            part = len(have & set(t.split())) / len(set(t.split()))
            if part >= threshold - 1e-9:
                labels.add(label)
                best = max(best, part)
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best


def compare(df):
    want = sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    got = sorted(((r.id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base), ",".join(r.labels), r.score) for r in scan_licenses(clashing(df)).collect()), key=str)
    assert got == want


def test_equals_brute_force(docs):
    compare(docs)


def test_odd_tables(odd_null, none):
    compare(odd_null)
    assert scan_licenses(none).collect() == []


def test_wording(spark):
    texts = [
        "CC-BY cc by cc by", "cc\nby", "a General  Public -- License all rights reserved", "All rights reservedx", "xall rights reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation",
        "licensed under the Apache license, version 2.0", "under the licensed apache 2 0 words", "released under the MIT license",
        "the of and to is in a with or by", "no part of this publication may be reproduced distributed or transmitted in any form\nwithout the prior written permission",
    ]
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy{0}of this software and associated documentation files"
BSD = "Redistribution and use in source and binary forms, with or without{0}modification, are permitted provided that the following conditions are met:"


def brute_across(text, threshold=0.8):
    """Best containment of each label, in lines and in runs of words."""
    w, out = WORD.findall(lower(text)), {}
    for label, t in TEMPLATES:
        want, m = set(t.split()), len(t.split())
        span = next(k for k in range(m, 2 * m) if k * threshold >= m - 1e-9)
        blocks = [w[i : i + span] for i in range(len(w))] + [WORD.findall(lower(x)) for x in (text or "").split("\n")]
        part = max((len(want & set(b)) / len(want) for b in blocks), default=0)
        if part >= threshold - 1e-9:
            out[label] = max(part, out.get(label, 0))
    return out


def test_wrapped_notices_in_the_query(spark, tmp_path):
    import random

    from clipledger.llm.queries import QUERIES

    rng = random.Random(3)
    texts = [MIT.format("\n"), BSD.format("\r\n * "), "/* " + MIT.format("\n\n") + "\n*/", MIT.format(" "), MIT.format("\n" + "other words " * 20), None, "", "\n"]
    for _, t in TEMPLATES * 4:
        words = [x for x in t.split() if rng.random() > 0.12]
        text = "".join(x + rng.choice([" ", " ", "\n", "\n# ", " other\n"]) for x in words)
        texts.append("Some lines ahead of\nthe notice " + text + " and the words behind it\nwith a last line")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()}
    assert [rows[i].labels for i in range(5)] == ["mit", "bsd", "mit", "mit", ""] and rows[0].score == rows[1].score == 1
    for i, text in enumerate(texts):
        base, found = {x for x in rows[i].base_labels.split(",") if x}, brute_across(text)
        assert rows[i].labels == ",".join(sorted(base | set(found))), text
        assert rows[i].score == (1 if base else max(found.values(), default=0)), text
