"""Integrity and lineage: checksum audits, exact-set audits, resume plans, registration checks, frozen evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.rules import Rule, apply_gates, failed_codes
from clipledger.operators.groups import by_group
from clipledger.session import join_same, settle

DIGEST_BLOCK = 1000


def audit_sets(expected: DataFrame, actual: DataFrame, key: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Full comparison of two keyed tables: one row per key with its differences as reasons."""
    e = expected.select(*key, *[F.col(c).alias(f"_e_{c}") for c in compare], F.lit(True).alias("_in_e"))
    a = actual.select(*[F.col(k).alias(f"_a_{k}") for k in key], *[F.col(c).alias(f"_a_{c}") for c in compare], F.lit(True).alias("_in_a"))
    cond = None
    for k in key:
        one = F.col(k).eqNullSafe(F.col(f"_a_{k}"))
        cond = one if cond is None else cond & one
    j = e.join(a, cond, "full_outer")
    both = F.col("_in_e").isNotNull() & F.col("_in_a").isNotNull()
    rules = [Rule("missing", F.col("_in_a").isNull()), Rule("unexpected", F.col("_in_e").isNull())]
    rules += [Rule(f"{c}_differs", both & ~F.col(f"_e_{c}").eqNullSafe(F.col(f"_a_{c}"))) for c in compare]
    keys = [F.coalesce(F.col(k), F.col(f"_a_{k}")).alias(k) for k in key]
    return j.select(*keys, failed_codes(rules).alias("reasons")).withColumn("same", F.size("reasons") == 0)


def unchanged(before: DataFrame, after: DataFrame, key: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """One row: whether two snapshots hold the same rows, and how many keys differ."""
    d = audit_sets(before, after, key, compare)
    return d.agg(F.coalesce(F.bool_and("same"), F.lit(True)).alias("unchanged"), F.count(F.when(~F.col("same"), 1)).alias("differences"))


def audit_files(expected: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Check expected files (path, size_bytes, sha256, width, height) against found ones (also binary_mask): every
    problem is a skip reason."""
    f = files.select("path", F.col("size_bytes").alias("_s"), F.col("sha256").alias("_h"), F.col("width").alias("_w"), F.col("height").alias("_ht"), "binary_mask", F.lit(True).alias("_found"))
    j = join_same(expected, f, ["path"], "left")
    found = F.col("_found").isNotNull()
    prefix = root.rstrip("/") + "/"
    return apply_gates(j, [
        Rule("outside_root", ~F.col("path").startswith(prefix) | F.col("path").contains("/../")),
        Rule("missing_file", ~found),
        Rule("size_mismatch", found & ~F.col("size_bytes").eqNullSafe(F.col("_s"))),
        Rule("hash_mismatch", found & ~F.col("sha256").eqNullSafe(F.col("_h"))),
        Rule("not_binary_mask", found & ~F.coalesce("binary_mask", F.lit(False))),
        Rule("dimension_mismatch", found & (~F.col("width").eqNullSafe(F.col("_w")) | ~F.col("height").eqNullSafe(F.col("_ht")))),
    ]).drop("_s", "_h", "_w", "_ht", "_found", "binary_mask", "details", "warnings")


def array_hash(values: Column, dtype: str, shape: Column) -> Column:
    """Content hash of an array that also covers its type and shape."""
    header = F.concat(F.lit(dtype + "|"), F.array_join(shape.cast("array<string>"), "x"), F.lit("|"))
    return F.sha2(F.concat(header, F.array_join(values.cast("array<string>"), ",")), 256)


def resume_plan(stages: DataFrame, artifacts: DataFrame, by: Sequence[str], stage: str = "stage", force: bool = False) -> DataFrame:
    """What to do with each stage: ``skip`` when it is completed and all its outputs are still valid, else ``run``.

    ``stages``: status, attempts. ``artifacts``: produced_by, in_root, size_bytes, found_size, sha256, found_sha256.
    Attempts are kept, also when forced.
    """
    by = list(by)
    ok = F.col("in_root") & F.col("size_bytes").eqNullSafe(F.col("found_size")) & F.col("sha256").eqNullSafe(F.col("found_sha256"))
    out = artifacts.groupBy(*by, F.col("produced_by").alias(stage)).agg(F.count("*").alias("outputs"), F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("_valid"))
    j = join_same(stages, out, by + [stage], "left").withColumn("outputs", F.coalesce("outputs", F.lit(0)))
    valid = (F.col("status") == "completed") & (F.col("outputs") >= 1) & F.coalesce("_valid", F.lit(False))
    return j.withColumn("action", F.when(valid & ~F.lit(force), "skip").otherwise("run")).drop("_valid")


def register_check(artifacts: DataFrame, by: Sequence[str], key: str, path: str, root: str) -> DataFrame:
    """Registration problems per artifact: empty or duplicate key, path outside the root. Keys are counted first and
    joined back, so copies of one key do not meet in a window."""
    n = artifacts.groupBy(*by, key).agg(F.count("*").alias("_n"))
    j = join_same(artifacts, n, [*by, key])
    inside = F.col(path).startswith(root.rstrip("/") + "/") & ~F.col(path).contains("/../")
    return apply_gates(j, [
        Rule("empty_key", F.length(F.trim(F.col(key))) == 0), Rule("duplicate_key", F.col("_n") > 1), Rule("outside_root", ~inside)]).drop("_n", "details", "warnings")


def media_audit(clips: DataFrame, frames: DataFrame, by: Sequence[str], index: str, decoded: Column) -> DataFrame:
    """Reported against decodable frames with probes at the first, middle and last position, and a verdict."""
    by = list(by)
    d = join_same(frames.withColumn("_ok", decoded), clips.select(*by, "reported"), by)
    first, last = F.col(index) == 0, F.col(index) == F.col("reported") - 1
    mid = F.col(index) == F.floor(F.col("reported") / 2)
    probe = lambda at: F.coalesce(F.bool_or(at & F.col("_ok")), F.lit(False))
    s = d.groupBy(*by).agg(F.count(F.when(F.col("_ok"), 1)).alias("decodable"), probe(first).alias("first_ok"), probe(mid).alias("middle_ok"), probe(last).alias("last_ok"))
    j = join_same(clips, s, by, "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("first_ok", "middle_ok", "last_ok")}).withColumn("decodable", F.coalesce("decodable", F.lit(0)))
    good = (F.col("decodable") == F.col("reported")) & F.col("first_ok") & F.col("middle_ok") & F.col("last_ok")
    return j.withColumn("verdict", F.when(good, "pass").otherwise("fail"))


def job_summary(stages: DataFrame, by: Sequence[str], status: str, updated: str) -> DataFrame:
    """Per job: number of stages per status (sorted map), last update and an overall state."""
    by = list(by)
    n = stages.groupBy(*by, status).agg(F.count("*").alias("_n"), F.max(updated).alias("_u"))
    s = n.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "_n")))).alias("counts"), F.sum("_n").alias("stages"), F.max("_u").alias("updated"),
        F.bool_or(F.col(status) == "failed").alias("_failed"), F.bool_and(F.col(status) == "completed").alias("_done"))
    return s.withColumn("state", F.when(F.col("_failed"), "failed").when(F.col("_done"), "completed").otherwise("pending")).drop("_failed", "_done")


def promote(artifacts: DataFrame, selection: DataFrame, by: Sequence[str], candidate: str, names: dict[str, str], name: str, content: Column) -> DataFrame:
    """Artifacts of the selected candidate only, under stable names, with size and hash of their content."""
    stable = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    won = join_same(artifacts, selection.select(*by, F.col("selected").alias(candidate)), [*by, candidate], "left_semi")
    d = won.withColumn("stable_name", stable[F.col(name)]).where("stable_name IS NOT NULL")
    return d.select(*by, "stable_name", F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content, 256).alias("sha256"))


def freeze(rows: DataFrame, by: Sequence[str], name: str, content: Column) -> DataFrame:
    """Digest of all named rows of a group, shared by every source compared on it.

    Row hashes are ordered by name and hashed in blocks, block hashes in turn until one is left, so a group of any
    size is digested by tasks that hold one block each.
    """
    by = list(by)
    d = rows.select(*by, F.col(name).alias("_o"), F.sha2(F.concat(F.col(name).cast("string"), F.lit("|"), content), 256).alias("_h"))
    count = rows.groupBy(*by).agg(F.count("*").alias("rows"))
    done = None
    while True:
        d = by_group(d, by, lambda d, g: g.rank(d, ["_o"], "_i")).withColumn("_b", F.expr(f"(_i - 1) div {DIGEST_BLOCK}"))
        block = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_h"))), lambda s: s["_h"])
        d = settle(d.groupBy(*by, F.col("_b").alias("_o")).agg(F.sha2(F.array_join(block, "\n"), 256).alias("_h")))
        # groups down to one block are finished; the others go on, so a digest depends on its own group only
        many = d.where("_o = 1").select(*by)
        one = join_same(d, many, by, "left_anti")
        done = one if done is None else done.unionByName(one)
        if many.isEmpty():
            return join_same(count, done.select(*by, F.col("_h").alias("digest")), by)
        d = join_same(d, many, by, "left_semi")
