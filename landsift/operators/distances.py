"""Nearest points on the ground, within or between point tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.functions import geo
from landsift.session import cut_lineage

SAFETY = 0.99
CROWD = 64  # distinct positions that a cell may hold
FINEST_M = 0.005


def metric_cells(cell_m: float, max_abs_lat: float) -> tuple[Column, Column]:
    """Grid cell indices of side ``cell_m``: points within SAFETY * cell_m of each
    other always lie in the same or in touching cells."""
    east = F.radians("lon") * (geo.SPHERE_M * math.cos(math.radians(max_abs_lat)))
    north = F.radians("lat") * geo.SPHERE_M
    return F.floor(east / cell_m), F.floor(north / cell_m)


def touching_cells(df: DataFrame) -> DataFrame:
    """Repeat each row for its own cell and the eight around it."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (
        df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        .withColumns({"cx": F.col("cx") + F.col("_dx"), "cy": F.col("cy") + F.col("_dy")}).drop("_dx", "_dy")
    )


def extent(points: DataFrame) -> tuple[float, float]:
    """(largest absolute latitude, diagonal in metres) of a point table."""
    row = points.agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")
    ).first()
    if row["w"] is None:
        return 0.0, 0.0
    lat = max(abs(row["s"]), abs(row["n"]))
    width = math.radians(row["e"] - row["w"]) * geo.SPHERE_M
    return lat, math.hypot(width, math.radians(row["n"] - row["s"]) * geo.SPHERE_M)


def uncrowded_cell(targets: DataFrame, by: list[str], cell: float, growth: int, max_lat: float) -> float:
    """The cell size, made finer until no cell holds a crowd of positions; a count per cell a step."""
    while cell > FINEST_M:
        cx, cy = metric_cells(cell, max_lat)
        fullest = targets.groupBy(*by, cx.alias("cx"), cy.alias("cy")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if fullest is None or fullest <= CROWD:
            break
        cell /= growth
    return cell


def by_exchange(df: DataFrame) -> DataFrame:
    """A join side that must not be broadcast: Spark guesses its size from compressed files, which may hold a
    small part of the bytes its rows take on the driver, and every position goes to touching cells besides."""
    return df.hint("merge")


def nearest(a: DataFrame, b: DataFrame, by: list[str], first_cell_m: float = 10.0, growth: int = 4, skip_self: bool = False) -> DataFrame:
    """Distance in metres from every distinct position of ``a`` to the nearest of ``b``.

    Positions are met on a grid. A hit no farther than the cell is final; only
    positions without one go on to the next, larger, cell. Equal positions are
    merged first, so copies cost nothing, and what is still open at a large
    cell has no close neighbour, so it is thin. Joins exchange both sides, so no
    positions pass the driver. Start near the point spacing (10 m for pixel centres); where positions crowd a cell of that size, the search
    starts with finer ones, down to ``FINEST_M``, so no cell is a key of many rows.
    ``skip_self`` is for a table against itself: a repeated position is at 0.
    """
    where = [*by, "lon", "lat"]
    open_set = cut_lineage(a.groupBy(*where).agg(F.count("*").alias("n")))
    targets = cut_lineage(b.select(*where).distinct())
    (lat_a, _), (lat_b, _) = extent(open_set), extent(targets)
    _, reach = extent(open_set.select("lon", "lat").unionByName(targets.select("lon", "lat")))
    max_lat = max(lat_a, lat_b)

    done = []
    if skip_self:
        done.append(open_set.filter("n > 1").withColumn("distance_m", F.lit(0.0)))
        open_set = open_set.filter("n = 1")
    cell = uncrowded_cell(targets, by, first_cell_m, growth, max_lat)
    while True:
        cx, cy = metric_cells(cell, max_lat)
        left = touching_cells(open_set.withColumns({"cx": cx, "cy": cy}))
        right = targets.select(*by, F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), cx.alias("cx"), cy.alias("cy"))
        pairs = by_exchange(left).join(by_exchange(right), [*by, "cx", "cy"])
        if skip_self:
            pairs = pairs.filter((F.col("lon") != F.col("lon2")) | (F.col("lat") != F.col("lat2")))
        metres = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
        hits = pairs.groupBy(*where).agg(F.min(metres).alias("distance_m"))
        step = cut_lineage(open_set.join(by_exchange(hits), where, "left"))
        final = cell * SAFETY > reach
        resolved = F.lit(True) if final else F.coalesce(F.col("distance_m") <= cell * SAFETY, F.lit(False))
        done.append(step.filter(resolved))
        open_set = step.filter(~resolved).drop("distance_m")
        if final or open_set.isEmpty():
            break
        cell *= growth
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def within_class_spacing(points: DataFrame, near_m: float = 100.0, first_cell_m: float = 10.0) -> DataFrame:
    """Per class: points, how many have another within ``near_m``, median nearest distance."""
    spaced = nearest(points.select("label", "lon", "lat"), points.select("label", "lon", "lat"), ["label"], first_cell_m, skip_self=True)
    return spaced.groupBy("label").agg(
        F.sum("n").alias("points"),
        F.sum(F.when(F.col("distance_m") <= near_m, F.col("n")).otherwise(0)).alias("near_points"),
        F.percentile("distance_m", 0.5, F.col("n")).alias("median_m"),
        F.max("distance_m").alias("max_m"),
    )


def displacement(a: DataFrame, b: DataFrame, by: list[str], first_cell_m: float = 10.0) -> DataFrame:
    """Largest and mean distance from ``a`` to its nearest point of ``b``."""
    moved = nearest(a, b, by, first_cell_m)
    return moved.groupBy(*by).agg(
        F.sum("n").alias("points"), F.max("distance_m").alias("max_m"),
        (F.sum(F.col("distance_m") * F.col("n")) / F.sum("n")).alias("mean_m"),
    )


def outside_buffer(points: DataFrame, training: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """Points with no training point within ``radius_m``.

    An anti join on the grid cell: a point is settled by the first training
    point found, pairs are never listed.
    """
    max_lat = max(extent(points)[0], extent(training)[0])
    cx, cy = metric_cells(radius_m / SAFETY, max_lat)
    sites = touching_cells(training.select("lon", "lat").distinct().withColumns({"cx": cx, "cy": cy})).select(
        F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("cx").alias("cx2"), F.col("cy").alias("cy2")
    )
    placed = points.withColumns({"cx": cx, "cy": cy})
    metres = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    near = (F.col("cx") == F.col("cx2")) & (F.col("cy") == F.col("cy2")) & (metres <= radius_m)
    return placed.join(by_exchange(sites), near, "left_anti").drop("cx", "cy")
