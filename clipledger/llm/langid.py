"""Language identification by mixture inference over letter n-grams."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.llm.common import per_worker, pick, small_side

UNKNOWN = "und"
BUCKET_BITS = 15


@dataclass
class LanguageModel:
    """Log probabilities of n-gram buckets for each language: ``logp[bucket, language]``."""

    languages: list[str]
    logp: np.ndarray


def _fold_table() -> np.ndarray:
    """Lower-cased letter for each code point of the basic plane; 0 for whatever is no letter."""
    out = np.zeros(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low[0])
    return out


def grams(text: str) -> tuple[np.ndarray, int]:
    """Hash buckets of all letter trigrams of a text, with one blank for each stretch without letters, and how many
    letters there are. Letters outside the basic plane stand for themselves."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = per_worker(("letters",), _fold_table)
    c = table[np.minimum(codes, 0xFFFF)]
    if len(codes) and codes.max() > 0xFFFF:
        far = np.flatnonzero(codes > 0xFFFF)
        c[far] = [x if unicodedata.category(chr(x))[0] == "L" else 0 for x in codes[far].tolist()]
    letters = int(np.count_nonzero(c))
    if not letters:
        return np.zeros(0, dtype=np.int32), 0
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    return (((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), letters


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, smooth: float = 0.5) -> LanguageModel:
    """N-gram model of each language that ``docs`` names. At most ``per_language`` documents of each language are
    read, those first in a hash order of their ids (an id alone decides, so the choice does not depend on file order);
    that bound is this parameter. Counts are summed in Spark; what comes to the driver is a count for each language
    and bucket. Rows with a null language or text teach nothing."""
    slim = pick(docs, id=id_col, lang=lang_col).where("lang IS NOT NULL").withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    # the share of the hash's range that surely holds enough goes to the ranking, not all rows of a language
    share = F.lit(float((1 << 40) * (per_language + 6 * math.sqrt(per_language) + 20))) / F.col("count")
    near = slim.join(small_side(slim.groupBy("lang").count(), 64), "lang").where(F.col("at") < share)
    order = Window.partitionBy("lang").orderBy("at", "id")
    chosen = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("id", "lang").distinct()
    chosen = small_side(chosen, 64)  # at most per_language rows of each language
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col).where("text IS NOT NULL").join(chosen, ["id", "lang"], "left_semi").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.bincount(grams(text)[0], minlength=1 << BUCKET_BITS)
                total[lang] = total[lang] + n if lang in total else n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(counted.column("lang").unique().to_pylist())
    counts = np.full((1 << BUCKET_BITS, len(langs)), smooth)
    at = np.searchsorted(langs, counted.column("lang").to_pylist()) if langs else np.zeros(0, np.int64)
    counts[counted.column("bucket").to_numpy(), at] += counted.column("n").to_numpy()
    return LanguageModel(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _expect(p: np.ndarray, starts: np.ndarray, n: np.ndarray, mix: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of mixture proportions for all documents of a stretch. ``p``: likelihood of each
    n-gram (row) in each language; ``mix``: the proportions to begin with, 0 for languages left out. Returns the
    proportions and the log likelihood."""
    for _ in range(rounds):
        w = p * np.repeat(mix, n, axis=0)
        w /= w.sum(axis=1, keepdims=True)
        mix = np.add.reduceat(w, starts, axis=0) / n[:, None]
    total = (p * np.repeat(mix, n, axis=0)).sum(axis=1)
    return mix, np.add.reduceat(np.log(total), starts)


def infer(model: LanguageModel, texts: list[str | None], most: int = 3, rounds: int = 8, cost: float = 4.0, least: float = 0.02) -> list[tuple[str, float, list[str], list[float]]]:
    """For each text: predicted language, its proportion, the selected set and its proportions, largest first.

    Selection is forward: the language with the highest likelihood alone, then the one along which the likelihood
    rises most, as long as it rises at all (its mean likelihood ratio to the mixture is above 1), and as long as
    expectation-maximisation over the larger set gains more than ``cost`` times half the logarithm of the number of
    n-grams. A language with a proportion below ``least`` is not taken.
    """
    found = [grams(t) if t else (np.zeros(0, np.int32), 0) for t in texts]
    out: list = [(UNKNOWN, 0.0, [], [])] * len(texts)
    rows = [i for i, (g, letters) in enumerate(found) if letters and model.languages]
    if not rows:
        return out
    n = np.array([len(found[i][0]) for i in rows])
    logs = model.logp[np.concatenate([found[i][0] for i in rows])]
    starts = np.cumsum(n) - n
    alone = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
    shift = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - shift)  # the shift of an n-gram is the same for all sets
    score = alone.max(axis=1) - np.add.reduceat(shift[:, 0], starts, dtype=np.float64)
    mix = np.zeros((len(rows), len(model.languages)), dtype=np.float32)
    mix[np.arange(len(rows)), alone.argmax(axis=1)] = 1
    live = np.arange(len(rows))  # documents whose set may still grow
    for _ in range(min(most, len(model.languages)) - 1):
        part = np.isin(np.arange(len(rows)), live)
        at, m, s = np.repeat(part, n), n[live], np.cumsum(n[live]) - n[live]
        q = p[at]
        mixed = (q * np.repeat(mix[live], m, axis=0)).sum(axis=1, keepdims=True)
        slope = np.add.reduceat(q / np.maximum(mixed, 1e-30), s, axis=0) / m[:, None]
        slope[mix[live] > 0] = 0
        best = slope.argmax(axis=1)
        rise = slope[np.arange(len(live)), best] > 1
        live, best = live[rise], best[rise]
        if not len(live):
            break
        at, m, s = np.repeat(np.isin(np.arange(len(rows)), live), n), n[live], np.cumsum(n[live]) - n[live]
        start = mix[live] * np.float32(0.8)
        start[np.arange(len(live)), best] += np.float32(0.2)
        fitted, gain = _expect(p[at], s, m, start, rounds)
        better = (gain - score[live] > cost * 0.5 * np.log(m)) & (fitted[np.arange(len(live)), best] >= least)
        live = live[better]
        mix[live], score[live] = fitted[better], gain[better]
        if not len(live):
            break
    for k, i in enumerate(rows):
        order = [j for j in np.argsort(-mix[k], kind="stable") if mix[k, j] > 0]
        share = [float(mix[k, j]) for j in order]
        out[i] = (model.languages[order[0]], min(1.0, share[0]), [model.languages[j] for j in order], share)
    return out


def _stretches(texts: list, chars: int = 1 << 18) -> Iterator[tuple[int, list]]:
    """Stretches of about ``chars`` code points at most; a longer text stands alone."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        if i > at and n + len(t or "") > chars:
            yield at, texts[at:i]
            at, n = i, 0
        n += len(t or "")
    if texts:
        yield at, texts[at:]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` (the predicted language's proportion), ``languages`` and ``proportions`` (the
    selected set, largest first) of whole texts; ``options`` go to :func:`infer`. The model is a bounded table and
    travels with the tasks.

    Null and empty texts and texts without letters, and all texts if the model knows no language: ``und``, 0 and empty
    sets. Rows are taken one by one, whatever their ids; other columns of ``docs`` play no part.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return identify_rows(rows, model, "text", **options).select("id", "lang_pred", "score", "languages", "proportions")


def identify_rows(docs: DataFrame, model: LanguageModel, text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score``, ``languages`` and ``proportions``, as in
    :func:`identify`. Columns of ``docs`` with these names are replaced."""
    names = ["lang_pred", "score", "languages", "proportions"]
    docs = docs.drop(*names)
    at = docs.columns.index(text_col)
    kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, [T.StringType(), T.DoubleType(), T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for _, some in _stretches(b.column(at).to_pylist()) for r in infer(model, some, **options)]
            if found:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
