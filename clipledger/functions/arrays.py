"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it inside ``fn``; a plain reference inside a lambda is evaluated per element."""
    return F.transform(F.array(value), fn)[0]


def normalised(a) -> Column:
    a = _c(a)
    return let(norm(a), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))


def mean_abs_diff(a, b) -> Column:
    a = _c(a)
    return F.try_divide(total(F.zip_with(a, _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))), F.size(a))


def squared_distance(a, b) -> Column:
    return total(
        F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    )


def softmax(a) -> Column:
    a = _c(a)
    raised = lambda top: F.transform(a, lambda x: F.exp(x - top))
    shared = lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))
    return let(let(F.array_max(a), raised), shared)


def argmax(a) -> Column:
    """Zero-based position of the first maximum."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def ordered_unit_angle(a, b) -> Column:
    """Angle in degrees between unit vectors, safe at the ends."""
    return F.degrees(F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))))


def unit_angle3(a, b) -> Column:
    """Angle in degrees between unit vectors of three, written out so that it stays in generated code."""
    a, b = _c(a), _c(b)
    cosine = sum((a[i] * b[i] for i in range(1, 3)), a[0] * b[0])
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
