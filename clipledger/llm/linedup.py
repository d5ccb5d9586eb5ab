"""Near-duplicate lines by a deletion-neighbourhood join. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import partitions, pick, small_side, staged
from clipledger.session import settle

BREAK = "\n"


def normal(line: Column) -> Column:
    """What is compared: lower-cased, white space at the ends and repeats of it dropped."""
    odd = line.contains("  ")
    for c in "\t\r\v\f":
        odd = odd | line.contains(c)
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")).otherwise(line)))


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def _rank(pos: str = "pos") -> Column:
    """Order of occurrences: by document id, null last, then text digest, then line number."""
    return F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("h").alias("h"), F.col(pos).alias("pos"))


def _lines(docs: DataFrame) -> DataFrame:
    """All lines: id, h (text digest), pos, line (normalised)."""
    split = docs.select("id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", BREAK)).alias("pos", "line"))
    return split.select("id", "h", "pos", normal(F.col("line")).alias("line"))


def _halves(line: Column, n: Column) -> Column:
    """Keys of which two lines within one edit share one. Of the two halves of the shorter, m characters long, the one
    without the edit stands unchanged at the same end of the longer; a key is a half together with m. A line may be
    either, hence m is its length or one less."""
    keys = []
    for m in (n, n - 1):
        half = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), m, F.substr(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("tail"), m, F.substr(line, n - (m - half) + 1, m - half)))
    return F.array(*keys)


def _variants(text: DataFrame) -> DataFrame:
    """Lines (a, b, rank, line) as keys ``v`` with a ``place``: each line itself (place 0) and each of its variants with
    one character deleted (place: which one, from 1). A key is the exclusive or of a hash for every character and its
    position. Behind a deletion all positions are one less; running sums over a line's characters, with their own
    positions and with those, give all its keys at the cost of its length."""
    n = partitions(text.sparkSession)
    chars = text.repartition(n, "a", "b").select("a", "b", "rank", F.posexplode(F.split("line", "")).alias("at", "c"))
    line = Window.partitionBy("a", "b")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chars = chars.select("a", "b", "rank", "at", F.xxhash64("at", "c").alias("own"), F.xxhash64(F.col("at") - 1, "c").alias("left"))
    sums = chars.select(
        "a", "b", "rank", "at", "own", F.bit_xor("own").over(upto).alias("before"), F.bit_xor("left").over(upto).alias("gone"),
        F.bit_xor("left").over(whole).alias("all"), F.max("at").over(whole).alias("last"),
    )
    before = F.col("before").bitwiseXOR(F.col("own"))
    variant = F.struct(before.bitwiseXOR(F.col("all")).bitwiseXOR(F.col("gone")).alias("v"), (F.col("at") + 1).alias("place"))
    itself = F.struct(F.col("before").alias("v"), F.lit(0).alias("place"))
    keys = F.when(F.col("at") == F.col("last"), F.array(itself, variant)).otherwise(F.array(variant))
    return sums.select("a", "b", "rank", F.explode(keys).alias("g")).select("a", "b", "rank", "g.v", "g.place")


def _without(line: str, place: Column) -> Column:
    """A line less the character at ``place`` (from 1; 0: all of it)."""
    return F.when(place == 0, F.col(line)).otherwise(F.concat(F.substr(line, F.lit(1), place - 1), F.substr(line, place + 1)))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """Lines to remove: ``id``, ``h`` (xxhash64 of the text), ``pos`` (line number from 0), ``near`` (false for a copy of
    an earlier line, true for one within an edit of an earlier one). Lines are compared as :func:`normal` makes them. A
    line goes if an earlier one, by id and line number, is equal, or, where both have at least ``min_chars`` characters,
    one inserted, deleted or replaced character away; so the earliest of a set of variants always stays. In shorter
    lines a character is too much of the whole to call them copies. Lines that are empty or blank are never removed.

    Deletion neighbourhood with an edit bound of 1: every line is a key, and every variant with one character deleted,
    together with the place of the deletion, is one (:func:`_variants`). Lines that share a variant and a place differ in that place
    alone; a line equal to another's variant is that other less one character. These are all cases of one edit, and
    each key's members are pairwise within the bound, so a key passes on its earliest line only and no pairs are
    listed. The edit is then verified on the two texts. Before that, halves of lines rule out
    all lines that no other can match (see ``_halves``): only lines that share a half are spread into variants.

    All copies of a line are one line in the joins (128-bit digests), so a line that a third of all documents hold is
    a single row after partial aggregation.
    """
    lines = _lines(pick(docs, id=id_col, text=text_col)).where("line != ''")
    size = F.length("line")
    # all lines, without their texts
    slim = staged(lines.select("id", "h", "pos", *_digest(F.col("line")), (size >= min_chars).alias("long"), _halves(F.col("line"), size).alias("halves")))
    distinct = slim.groupBy("a", "b").agg(F.min(_rank()).alias("rank"), F.count("*").alias("copies"), F.first("long").alias("long"), F.first("halves").alias("halves"))
    distinct = staged(distinct.select("a", "b", "rank", "copies", "long", "halves"))
    halves = distinct.where("long").select("a", "b", "rank", F.explode("halves").alias("half"))
    shared = small_side(halves.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").select("half"), 16)
    firsts = small_side(halves.join(shared, "half").select("a", "b", "rank").distinct(), 64)
    # texts of those lines, from their earliest place
    text = lines.where(size >= min_chars).select("line", *_digest(F.col("line")), _rank().alias("at")).join(firsts, ["a", "b"]).where("at = rank")
    text = settle(text.select("a", "b", "rank", "line"))
    # every line and every variant as a key; keys that a single line has lead nowhere
    keyed = _variants(text)
    busy = keyed.groupBy("v").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x != y").select("v")
    keyed = settle(keyed.join(small_side(busy, 16), "v"))
    who, lines_of, variants = F.struct("rank", "a", "b", "place").alias("who"), keyed.where("place = 0"), keyed.where("place > 0")
    earlier = lambda df: df.where(F.col("low.rank") < F.col("rank")).select("a", "b", F.col("low.a").alias("c"), F.col("low.b").alias("d"), F.struct(F.col("place").alias("p"), F.col("low.place").alias("q")).alias("cut"))
    # the same place: one replaced character
    replaced = variants.join(variants.groupBy("v", "place").agg(F.min(who).alias("low")), ["v", "place"])
    # a variant that is itself a line: one character more or less
    less = lines_of.join(variants.groupBy("v").agg(F.min(who).alias("low")), "v")
    more = variants.join(lines_of.groupBy("v").agg(F.min(who).alias("low")), "v")
    pairs = earlier(replaced).unionByName(earlier(less)).unionByName(earlier(more)).groupBy("a", "b", "c", "d").agg(F.min("cut").alias("cut"))
    one, two = text.select("a", "b", F.col("line").alias("line")), text.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("line").alias("earlier"))
    # both without the deleted character, at the cost of their length
    same = _without("line", F.col("cut.p")) == _without("earlier", F.col("cut.q"))
    near = pairs.join(one, ["a", "b"]).join(two, ["c", "d"]).where(same).select("a", "b").distinct()
    # decisions: what is not the earliest copy, and all copies of near lines
    judged = distinct.select("a", "b", "rank", "copies").join(near.withColumn("near", F.lit(True)), ["a", "b"], "left").where("copies > 1 OR near")
    judged = small_side(judged.select("a", "b", "rank", "near"), 72)
    places = slim.select("a", "b", "id", "h", "pos", _rank().alias("at")).join(judged, ["a", "b"]).where("near OR at != rank")
    return places.select("id", "h", "pos", F.coalesce("near", F.lit(False)).alias("near"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """The documents with their lines cleaned: all columns of ``docs``, the text without the lines that
    :func:`line_decisions` removes, and ``n_removed``, ``removed`` (line numbers from 0, ascending). A document all of
    whose lines go keeps its row with an empty text. Null texts stay null with nothing removed; empty tables give no
    rows. Rows equal in id and text are one document to the decisions and lose the same lines. A column of ``docs``
    called n_removed or removed is replaced.
    """
    gone = line_decisions(docs, id_col, text_col, min_chars).groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    gone = small_side(gone.select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("removed").alias("__gone")), 96)
    docs = docs.drop("n_removed", "removed")
    text = docs[f"`{text_col}`"]
    out = docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h")), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), BREAK), lambda x, i: ~F.array_contains(F.col("__gone"), i)), BREAK)
    out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(f"`{text_col}`")).otherwise(kept))
    removed = F.coalesce("__gone", F.array().cast("array<int>"))
    return out.withColumn("n_removed", F.size(removed).cast("long")).withColumn("removed", removed).drop("__id", "__h", "__gone")
