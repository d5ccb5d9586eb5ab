"""Generators as table functions for SQL: ``SELECT … FROM t, LATERAL fan_triangles(t.ids)``. Each call is one input row;
rows are made one after another, so nothing is held."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="part int, v0 bigint, v1 bigint, v2 bigint")
class FanTriangles:
    """Triangles (first, k, k + 1) of a polygon's corner ids; fewer than three corners give none."""

    def eval(self, ids: list) -> Iterator[tuple]:
        for k in range(1, len(ids or []) - 1):
            yield k - 1, ids[0], ids[k], ids[k + 1]


@udtf(returnType="y int, x int")
class BoxPixels:
    """Pixels of the box from (y0, x0) to (y1, x1), both included."""

    def eval(self, y0: int, y1: int, x0: int, x1: int) -> Iterator[tuple]:
        if None not in (y0, y1, x0, x1):
            for y in range(y0, y1 + 1):
                for x in range(x0, x1 + 1):
                    yield y, x


@udtf(returnType="iz int, iy int, ix int, x double, y double, z double")
class GridCells:
    """Cells of a cubic grid with their centres, from ``low`` to ``high`` along each axis."""

    def eval(self, resolution: int, low: float, high: float) -> Iterator[tuple]:
        if resolution is None or resolution < 2:
            return
        at = [low + i * ((high - low) / (resolution - 1)) for i in range(resolution)]
        for iz in range(resolution):
            for iy in range(resolution):
                for ix in range(resolution):
                    yield iz, iy, ix, at[ix], at[iy], at[iz]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session as fan_triangles, box_pixels and grid_cells."""
    for name, fn in (("fan_triangles", FanTriangles), ("box_pixels", BoxPixels), ("grid_cells", GridCells)):
        spark.udtf.register(name, fn)
