"""Sinks that publish reports once and never with unmeasured numbers written as NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def no_nan(df: DataFrame) -> DataFrame:
    """Fail the write if a floating-point value, also inside structs, arrays and maps, is NaN or infinite."""

    def each(t):
        return lambda x: good(x, t)

    def good(c, t):
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return c.isNull() | (~F.isnan(c) & (F.abs(c) != float("inf")))
        if isinstance(t, T.StructType):
            tests = [good(c[f.name], f.dataType) for f in t.fields]
            tests = [x for x in tests if x is not None]
            out = None
            for x in tests:
                out = x if out is None else out & x
            return None if out is None else c.isNull() | out
        if isinstance(t, T.ArrayType):
            probe = good(F.lit(None).cast(t.elementType), t.elementType)
            return None if probe is None else c.isNull() | F.forall(c, lambda x: good(x, t.elementType))
        if isinstance(t, T.MapType):
            held = [good(F.lit(None).cast(k), k) is not None for k in (t.keyType, t.valueType)]
            parts = [F.forall(part(c), each(k)) for part, k, h in ((F.map_keys, t.keyType, held[0]), (F.map_values, t.valueType, held[1])) if h]
            return None if not parts else c.isNull() | (parts[0] & parts[-1])
        return None

    tests = [(f.name, good(F.col(f.name), f.dataType)) for f in df.schema.fields]
    checks = [F.assert_true(x, f"{n} holds a value that is not finite") for n, x in tests if x is not None]
    if not checks:
        return df
    # the checks ride on the first column, so that they cannot be pruned away
    first = df.columns[0]
    passed = F.coalesce(*[c.cast("string") for c in checks]).isNull()
    return df.withColumn(first, F.when(passed, F.col(first)))


def publish(df: DataFrame, path: str, form: str = "json") -> None:
    """Write a report once: an existing path is an error, columns are sorted, non-finite numbers are refused."""
    ordered = df.select(*sorted(df.columns))
    no_nan(ordered).write.mode("errorifexists").format(form).save(path)
