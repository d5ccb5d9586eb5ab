"""Exact removal of repeated stretches of text by unit hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import pick, staged

#: A unit with the white space after it, for each level from coarse to fine. Levels may be combined.
UNITS = {
    "paragraph": re.compile(r".+?(?:\n[ \t\r\f\v]*\n\s*|\Z)", re.S),
    "line": re.compile(r"[^\n]+\n*"),
    "sentence": re.compile(r"[^\n]+?(?:[.!?]+(?=\s|\Z)[ \t\r\f\v]*|(?=\n)|\Z)"),
}
SPLIT = "id long, h long, start long, end long, a long, b long"
SPANS = [("id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]


def units(docs: DataFrame, levels: Sequence[str], min_words: int) -> DataFrame:
    """Units of whole texts (columns id, text, h) with at least ``min_words`` words: ``id``, ``h``, ``start`` and
    ``end`` in code points of the original text, ``a`` and ``b``, a 128-bit digest of the unit in lower case with
    white space reduced to single blanks. ``h`` tells apart texts of one id."""
    shapes = [UNITS[x] for x in levels]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            cols: list[list] = [[], [], [], []]
            digests: list[bytes] = []
            for i, text, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = text.as_py() or ""
                for level, shape in enumerate(shapes):
                    for m in shape.finditer(text):
                        words = m.group().lower().split()
                        if len(words) >= min_words:
                            for c, v in zip(cols, (i, h, m.start(), m.end())):
                                c.append(v)
                            digests.append(xxh3_128_digest(" ".join(words), level))
                if len(digests) >= 50_000:
                    yield rows(cols, digests)
                    cols, digests = [[], [], [], []], []
            if digests:
                yield rows(cols, digests)

    def rows(cols: list[list], digests: list[bytes]) -> pa.RecordBatch:
        d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(d[:, 0]), pa.array(d[:, 1])], schema=pa.schema(SPANS))

    return docs.select("id", "text", "h").mapInArrow(cut, SPLIT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: Sequence[str] = ("line", "sentence"), min_words: int = 5) -> DataFrame:
    """Whole texts without what an earlier document or an earlier place of the same one holds already: ``id``,
    ``text`` (cleaned), ``n_chars`` (code points of the original), ``n_removed`` (of them removed), ``removed`` (spans
    of the original text: ``start``, ``end``, and ``first_id``, the document that keeps the earliest occurrence;
    where units of two levels overlap, the coarser one's span comes first and covers the finer).

    Line and paragraph hashing: texts are cut into units, by default lines and, within lines, sentences, so that a
    passage set into a longer line is found too; digests of the normalised units are grouped globally, the occurrence
    first in order of (id, text digest, start) stays, the rest goes. Units with fewer than ``min_words`` words stay.
    The grouping is a partial aggregate, and only digests that occur twice are joined back, so a unit that a third of
    all documents hold is one row on that side and split by the skew handling on the other.

    Null text: empty, nothing removed. Null ids come last in the order. Rows equal in id and text are one document to
    the decisions: both keep or lose a unit. Empty table: no rows. Other columns of ``docs`` play no part.
    """
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = staged(units(rows, levels, min_words))
    place = F.struct(F.col("id").isNull().alias("n"), "id", "h", "start")
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("a", "b", "first")
    again = found.join(first, ["a", "b"]).where(place > F.col("first")).select("id", "h", "start", "end", F.col("first.id").alias("first_id"))
    spans = again.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), "end", "first_id"))).alias("spans"))
    spans = spans.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.first_id.alias("first_id"))).alias("removed"))
    joined = rows.join(spans, rows.id.eqNullSafe(F.col("_id")) & (rows.h == F.col("_h")), "left").select("id", "text", "removed")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, cuts in zip(b.column(1), b.column(2)):
                text, kept, at = text.as_py(), [], 0
                for c in cuts.as_py() or []:
                    if c["start"] > at:
                        kept.append(text[at : c["start"]])
                    at = max(at, c["end"])
                kept.append(text[at:])
                left = "".join(kept)
                out.append((left, len(text), len(text) - len(left)))
            new, n, gone = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), b.column(2)], names=["id", "text", "n_chars", "n_removed", "removed"])

    return joined.withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:long,end:long,first_id:long>>"))).mapInArrow(clean, "id long, text string, n_chars long, n_removed long, removed array<struct<start:long,end:long,first_id:long>>")
