"""How many boxes of a table each position lies in, without a row for each pair.

A box is told by its corners: a position is in it when it has passed the two minima and not the maxima. So the
boxes around a position are a sum over the corners that precede it in both coordinates, where a corner of one
minimum and one maximum counts against the others. Those sums need no pairs. Points (corners and positions)
are dealt into slabs of latitude and slabs of longitude, and the corners that precede a position are in

* slabs before its own on both sides: a sum over the small grid of slabs,
* its own slab of latitude, at any longitude before it: summed within that slab,
* its own slab of longitude, in slabs of latitude before its own: summed within that slab.

A slab is summed by one task after sorting; work and shuffles grow with the points, whatever the pairs are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Points that a slab should hold, and the slabs of a coordinate: their grid is a table of at most that many squared.
SLAB_POINTS = 20_000
MOST_SLABS = 512
# How a point compares with another of the same coordinate: a minimum precedes a position, a maximum follows it.
MINIMUM, POSITION, MAXIMUM = 0, 1, 2
POINT = ("lat", "lat_kind", "lon", "lon_kind")


def _corners(regions: DataFrame) -> DataFrame:
    corners = ", ".join(
        f"struct(double({lat}_lat) AS lat, {kinds[lat]} AS lat_kind, double({lon}_lon) AS lon, {kinds[lon]} AS lon_kind,"
        f" {1 if lat == lon else -1}L AS weight)"
        for kinds in [{"min": MINIMUM, "max": MAXIMUM}] for lat in kinds for lon in kinds
    )
    return regions.where("min_lat <= max_lat AND min_lon <= max_lon").selectExpr(f"inline(array({corners}))")


def _slab(column: str, edges: list[float]):
    """Number of the slab a coordinate is in, equal ones in the same; NaN comes last, as in Spark's order."""
    bounds = np.array(edges, "float64")

    @F.pandas_udf("int")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy("float64"), side="right").astype("int32"))

    return of(column)


def _edges(points: DataFrame) -> tuple[list[float], list[float]]:
    """Coordinates that part the points into slabs of about as many points."""
    shares = [i / MOST_SLABS for i in range(1, MOST_SLABS)]
    quantiles = [F.percentile_approx(c, shares, 20 * MOST_SLABS).alias(c) for c in ("lat", "lon")]
    found = points.agg(F.count(F.lit(1)).alias("n"), *quantiles).first()
    slabs = min(MOST_SLABS, math.ceil(found["n"] / SLAB_POINTS))
    wanted = [round(i * MOST_SLABS / slabs) - 1 for i in range(1, slabs)]
    lat, lon = ([found[c][i] for i in wanted] for c in ("lat", "lon"))
    return np.unique(lat).tolist(), np.unique(lon).tolist()


def _before(grid: DataFrame, column: str, along: str, across: str):
    rows = Window.partitionBy(across).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn(column, F.coalesce(F.sum(column).over(rows), F.lit(0)))


def _summed():
    """The function of a slab. It is made here so that it travels whole, to workers without this package too."""

    def preceding(slab: pa.Table) -> pa.Table:
        """Positions of a slab with the weights of the points before them in both orders.

        The points are listed by longitude. Their places in the other order are halved again and again: a point
        in a right half is preceded by those of the left half beside it that are listed before it.
        """
        n = slab.num_rows
        rank, rank_kind, lon, kind, weight = (
            slab.column(c).to_numpy() for c in ("rank", "rank_kind", "lon", "lon_kind", "weight")
        )
        place = np.empty(n, "int64")
        place[np.lexsort((rank_kind, rank))] = np.arange(n)
        listed = np.lexsort((kind, lon))
        place, weight = place[listed], weight[listed]
        total, at = np.zeros(n, "int64"), np.arange(n)
        for shift in range(n.bit_length() - 1, -1, -1):
            half = place[at] >> shift
            right = (half & 1).astype(bool)
            run = np.cumsum(np.where(right, 0, weight[at]))
            starts = np.flatnonzero(np.diff(half >> 1, prepend=-1))
            base = np.repeat(np.where(starts > 0, run[starts - 1], 0), np.diff(starts, append=n))
            total[at[right]] += (run - base)[right]
            at = at[np.argsort(half, kind="stable")]
        wanted = kind[listed] == POSITION
        at = pa.array(listed[wanted])
        return pa.table({"lat": slab.column("lat").take(at), "lon": slab.column("lon").take(at), "n": total[wanted]})

    return preceding


def boxes_around(positions: DataFrame, regions: DataFrame) -> DataFrame:
    """lat, lon and ``n``, the number of boxes, of every place that a position has and that is in a box.

    Coordinates compare as Spark compares doubles: NaN equals itself and is above all else. A box with a null,
    or with a minimum above its maximum, holds nothing. The edges of the slabs are found when this is called.
    """
    spark = positions.sparkSession
    places = positions.where("latitude IS NOT NULL AND longitude IS NOT NULL").selectExpr(
        "double(latitude) AS lat", f"{POSITION} AS lat_kind", "double(longitude) AS lon", f"{POSITION} AS lon_kind",
        "0L AS weight",
    )
    points = _corners(regions).unionByName(places).groupBy(*POINT).agg(F.sum("weight").alias("weight"))
    by_lat, by_lon = _edges(points)
    dealt = points.withColumns({"row": _slab("lat", by_lat), "column": _slab("lon", by_lon)})
    is_place = F.col("lat_kind") == POSITION

    slabs = [spark.range(len(edges) + 1).select(F.col("id").cast("int").alias(c))
             for c, edges in (("row", by_lat), ("column", by_lon))]
    cells = dealt.where(~is_place).groupBy("row", "column").agg(F.sum("weight").alias("n"))
    grid = slabs[0].crossJoin(slabs[1]).join(cells, ["row", "column"], "left").fillna(0, ["n"])
    grid = _before(_before(grid, "n", "column", "row"), "n", "row", "column")
    whole = dealt.where(is_place).join(grid, ["row", "column"]).select("lat", "lon", "n")

    # Of two points in the same slab of latitude none precedes the other here: positions come first.
    later = F.when(is_place, 0).otherwise(1)
    sides = F.array(
        F.struct(F.lit("row").alias("side"), F.col("row").alias("slab"), F.col("lat").alias("rank"),
                 F.col("lat_kind").alias("rank_kind")),
        F.struct(F.lit("column").alias("side"), F.col("column").alias("slab"), F.col("row").cast("double").alias("rank"),
                 later.alias("rank_kind")),
    )
    within = dealt.select(F.inline(sides), "lat", "lon", "lon_kind", "weight").groupBy("side", "slab").applyInArrow(
        _summed(), "lat double, lon double, n long"
    )
    return whole.unionByName(within).groupBy("lat", "lon").agg(F.sum("n").alias("n")).where("n > 0")
