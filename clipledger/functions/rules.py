"""Evidence gates: rules evaluated per row, giving a decision with ordered reason codes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``fails`` is true when the evidence is not good enough; unmeasured (null) evidence fails too."""

    code: str
    fails: Column
    message: str = ""
    observed: Column | None = None
    required: Any = None
    warning: bool = False

    def failed(self) -> Column:
        # a warning needs positive evidence, a failure only missing evidence
        return F.coalesce(self.fails, F.lit(not self.warning))


def failed_codes(rules: list[Rule]) -> Column:
    """Distinct codes of failed rules, in rule order."""
    if not rules:
        return F.array().cast("array<string>")
    codes = F.array(*[F.when(r.failed(), F.lit(r.code)) for r in rules])
    return F.array_distinct(F.filter(codes, lambda x: x.isNotNull()))


def _detail(r: Rule) -> Column:
    observed = F.lit(None).cast("string") if r.observed is None else r.observed.cast("string")
    required = r.required.cast("string") if isinstance(r.required, Column) else F.lit(r.required).cast("string")
    return F.struct(
        F.lit(r.code).alias("code"), F.lit(r.message).alias("message"), observed.alias("observed"), required.alias("required")
    )


def apply_gates(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``accepted``, ``reasons``, ``warnings`` and ``details``; weak evidence never raises."""
    hard = [r for r in rules if not r.warning]
    soft = [r for r in rules if r.warning]
    details = F.array(*[F.when(r.failed(), _detail(r)) for r in hard])
    out = df.withColumn("reasons", failed_codes(hard)).withColumn("warnings", failed_codes(soft))
    return out.withColumn("details", F.filter(details, lambda x: x.isNotNull())).withColumn(
        "accepted", F.size("reasons") == 0
    )


def bounds(column: str, low=None, high=None, code: str | None = None) -> Rule:
    """Violation when a value is null, NaN, infinite or outside ``[low, high]``."""
    c = F.col(column).cast("double")
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return Rule(code or f"{column}_out_of_range", bad, f"{column} must be finite and in range", c, f"[{low}, {high}]")


def one_of(column: str, allowed: list[str], code: str | None = None) -> Rule:
    """Violation when a value is not in the list."""
    c = F.col(column)
    return Rule(code or f"{column}_unknown", ~c.isin(*allowed), f"{column} must be a known value", c, ",".join(allowed))
