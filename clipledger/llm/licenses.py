"""Licence scans: phrases in their place, and an exact set-similarity join with notice templates. SQL functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import pick, staged
from clipledger.session import join_same, settle

#: What separates words, after lower-casing: ASCII without letters and digits.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases looked for word by word, and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as sets of words, and their labels. Several may share a label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "no part of this publication may be reproduced distributed or transmitted in any form without the prior written permission of the publisher"),
)


def _words(text: Column) -> Column:
    """Words in order, as an array. Lower-casing reaches beyond A-Z; that neither moves a word's border nor makes a phrase,
    since no such letter becomes one of a phrase's alone."""
    return F.array_remove(F.split(F.lower(text), GAP), "")


def _array(words) -> Column:
    return F.array(*map(F.lit, words))


def _need(n: int, threshold: float) -> int:
    """Words that ``threshold`` of ``n`` words are, rounded up."""
    return -int(-(threshold * n - 1e-9) // 1)


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """Columns ``seq`` (words in order) and ``have`` (distinct words, those of phrases at least) of ``docs`` read for
    phrases: ``n_words``, ``n_base`` (places of all phrases), ``first_word``, ``last_word`` (smallest and largest start in
    words from 0), ``base`` (labels found). Only a text that holds all words of a phrase is put together for it."""
    others = [c for c in docs.columns if c != "seq"]
    possible = F.exists(F.array(*[_array(p.split()) for p in phrases]), lambda p: F.size(F.array_except(p, F.col("have"))) == 0)
    joined = F.when(possible, F.concat(F.lit(" "), F.array_join("seq", " "), F.lit(" ")))
    docs = docs.select(*others, F.size("seq").alias("n_words"), joined.alias("words"))
    w = F.col("words")
    count, first, last, label = [], [], [], []
    for phrase, name in phrases.items():
        p, there = f" {phrase} ", w.contains(f" {phrase} ")
        count.append(F.when(there, F.regexp_count(w, F.lit(f"(?={p})"))).otherwise(0))
        head = F.substr(w, F.lit(1), F.locate(p, w))
        first.append(F.when(there, _blanks(head) - 1))
        tail = F.substring_index(w, p, -1)
        last.append(F.when(there, F.col("n_words") - _blanks(tail) - len(phrase.split())))
        label.append(F.when(there, F.lit(name)))
    add = count[0]
    for c in count[1:]:
        add = add + c
    return docs.select(
        *others,
        F.col("n_words").cast("long").alias("n_words"),
        add.cast("long").alias("n_base"),
        F.least(*first, F.lit(None)).cast("long").alias("first_word"),
        F.greatest(*last, F.lit(None)).cast("long").alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*label))).alias("base"),
    )


def _read(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """The one pass over the texts of ``docs`` (id, h, text), written to the shared folder once: the columns of
    :func:`phrase_places`, ``have`` (words of templates and phrases in the text), ``near`` (places in ``templates`` of those
    the text as a whole holds the needed words of), and ``text``, null where no template is near. Neither a line nor a run
    of words holds more than its text, so no others can match."""
    sets = [sorted(set(text.split())) for _, text in templates]
    known = _array(sorted({w for ws in sets for w in ws} | {w for p in PHRASES for w in p.split()}))
    each = F.array(*[F.struct(F.lit(i).alias("t"), _array(ws).alias("ws"), F.lit(_need(len(ws), threshold)).alias("need")) for i, ws in enumerate(sets)])
    near = F.transform(F.filter(each, lambda t: F.size(F.array_intersect(F.col("have"), t.ws)) >= t.need), lambda t: t.t)
    rows = docs.select("id", "h", "text", _words(F.col("text")).alias("seq"))
    rows = rows.select("*", F.array_intersect(known, "seq").alias("have"))
    rows = phrase_places(rows.select("*", near.alias("near")))
    return staged(rows.withColumn("text", F.when(F.size("near") > 0, F.col("text"))))


def _spanning(held: DataFrame, templates, threshold: float) -> DataFrame:
    """Notices that line breaks cut: for a template of m words (repeats counted), the run of m / ``threshold`` words of
    the text, rounded up, that holds most of its distinct words; so as many words may stand in between as may be
    missing. ``id``, ``h``, ``label``, ``containment`` (``threshold`` at least), of rows of :func:`_read` with a text.

    Only templates near the text are looked for. The best run begins with a word of the template, so only those are tried.
    """
    sets = [(label, sorted(set(text.split())), -int(-len(text.split()) / threshold // 1)) for label, text in templates]
    each = F.array(*[F.struct(F.lit(label).alias("label"), _array(ws).alias("ws"), F.lit(_need(len(ws), threshold)).alias("need"), F.lit(span).alias("span")) for label, ws, span in sets])
    rows = held.where(F.col("text").contains("\n")).select("id", "h", _words(F.col("text")).alias("seq"), F.explode("near").alias("near"))
    numbered = F.transform("seq", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    rows = rows.select("id", "h", F.get(each, F.col("near")).alias("t"), numbered.alias("numbered"))
    rows = rows.select("id", "h", "t", F.filter("numbered", lambda x: F.array_contains(F.col("t.ws"), x.w)).alias("hits"))
    within = lambda x, k: F.filter(F.slice("hits", k + 1, F.col("t.span")), lambda y: y.i < x.i + F.col("t.span"))
    most = F.array_max(F.transform("hits", lambda x, k: F.size(F.array_distinct(F.transform(within(x, k), lambda y: y.w)))))
    rows = rows.select("id", "h", "t", most.alias("most"))
    # filtered behind the aggregate: a filter on ``most`` would move below and find the hits anew for each hit
    share = F.when(F.col("most") >= F.col("t.need"), F.col("most") / F.size("t.ws"))
    return rows.groupBy("id", "h", F.col("t.label").alias("label")).agg(F.max(share).alias("containment")).where("containment IS NOT NULL")


def template_matches(read: DataFrame, templates=TEMPLATES, threshold: float = 0.8, wrapped: bool = False) -> DataFrame:
    """Text blocks (lines) that hold at least ``threshold`` of a template's words: ``id``, ``h``, ``block`` (line number
    from 0), ``label``, ``containment``. ``read`` comes from :func:`_read` with the same templates and threshold. With
    ``wrapped``, runs of words across lines too (see :func:`_spanning`), with a null block.

    Exact set-similarity join. Words are put in one global order, rarest in the documents first; only words of
    templates can meet, so a block is reduced to those. Of a template with n words and need = ceil(threshold * n), a
    block that holds ``need`` of them must hold one of the first n - need + 1 in the order (prefix filter) and have
    ``need`` words itself (length filter), and from the first common word on both sets must still have room for ``need``
    (positional filter). Pairs that pass are counted exactly. The document counts of the templates' own words, a few
    hundred numbers whatever the input, come to the driver to fix the order.
    """
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    often = {r["w"]: r["count"] for r in read.select(F.explode("have").alias("w")).groupBy("w").count().collect()}
    order = sorted({w for _, ws in sets for w in ws}, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for label, ws in sets:
        ranked, need = sorted(ws, key=rank.get), _need(len(ws), threshold)
        entries += [(label, w, at, len(ws), need, ranked) for at, w in enumerate(ranked[: len(ws) - need + 1])]
    # prefixes of the templates: as many rows as they have words at most
    prefix = read.sparkSession.createDataFrame(entries, "label string, w string, i int, n int, need int, ws array<string>")
    fewest = min(e[4] for e in entries)
    held = read.where("text IS NOT NULL")
    # lines are reduced within the generator, so that filters behind it do not reduce them anew
    lines = F.transform(F.split("text", "\n"), lambda line: F.array_intersect(_array(order), _words(line)))
    blocks = held.select("id", "h", F.posexplode(lines).alias("block", "have")).where(F.size("have") >= fewest)
    tokens = blocks.select("id", "h", "block", "have", F.posexplode("have").alias("j", "w"))
    met = tokens.join(F.broadcast(prefix), "w").where((F.size("have") >= F.col("need")) & (F.lit(1) + F.least(F.col("n") - 1 - F.col("i"), F.size("have") - 1 - F.col("j")) >= F.col("need")))
    common = F.size(F.array_intersect("have", "ws"))
    met = met.select("id", "h", "block", "label", (common / F.col("n")).alias("containment"), common.alias("common"), "need").where("common >= need")
    found = met.groupBy("id", "h", "block", "label").agg(F.max("containment").alias("containment"))
    if not wrapped:
        return found
    return found.unionByName(_spanning(held, templates, threshold).withColumn("block", F.lit(None).cast("int")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = 0.8, wrapped: bool = False) -> DataFrame:
    """For each document: ``id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base`` (labels of phrases)
    (see :func:`phrase_places`), ``labels`` (with those of :func:`template_matches`; distinct, sorted), ``score``: 1
    with a phrase, else the highest containment of a template, 0 without a match. Templates are looked for in lines, with ``wrapped``
    also in words that go on over line breaks.

    Null text: empty. A text without a phrase has null places. Rows equal in id and text get the same labels. Empty
    table: no rows. Other columns of ``docs`` play no part.
    """
    rows = pick(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    own = _read(rows.select("id", F.xxhash64("text").alias("h"), "text"), templates, threshold)
    more = settle(template_matches(own, templates, threshold, wrapped).groupBy("id", "h").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best")))
    out = join_same(own, more, ["id", "h"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0)))
    return out.select("id", "n_words", "n_base", "first_word", "last_word", F.array_sort("base").alias("base"), labels.alias("labels"), score.alias("score"))
