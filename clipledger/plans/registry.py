"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger.session import Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL, if it has one."""

    def wrap(fn):
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def r6(c: Column | str) -> Column:
    """Round to 6 places and turn -0.0 into 0.0, as done on the SQL side."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def q6(e: str) -> str:
    return f"(round(CAST({e} AS DOUBLE), 6) + 0.0)"


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def vector_parts(t, n: int):
    """All embeddings cut into parts of ``n`` values, each a row: vec_id, label, part (from 0) and values (doubles)."""
    from pyspark.sql import functions as F

    values = F.transform("embedding", lambda x: x.cast("double"))
    at = F.explode(F.sequence(F.lit(0), F.expr(f"size(embedding) div {n} - 1")))
    return t.embeddings.select("vec_id", "label", values.alias("_v"), at.alias("part")).select("vec_id", "label", F.col("part").cast("long").alias("part"), F.slice("_v", F.col("part") * n + 1, n).alias("values"))


def parts_sql(n: int) -> str:
    """The same rows, with values v1 to v<n>."""
    cols = ", ".join(f"CAST(embedding[part * {n} + {i + 1}] AS DOUBLE) AS v{i + 1}" for i in range(n))
    return f"(SELECT vec_id, label, part, {cols} FROM embeddings, range(0, 64 // {n}) AS r(part))"


def joined(c: Column | str) -> Column:
    """Array of strings as one text."""
    return F.array_join(c, ",")


def codes_sql(*rules: tuple[str, str] | tuple[str, str, bool]) -> str:
    """SQL for the joined failed codes of (code, failing condition[, warning]) rules; unknown fails."""
    parts = [f"CASE WHEN coalesce({r[1]}, {'false' if len(r) > 2 and r[2] else 'true'}) THEN '{r[0]}' END" for r in rules]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"
