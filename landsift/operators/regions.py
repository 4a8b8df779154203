"""Polygons against pixels and points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.functions import geo
from landsift.session import cut_lineage

EDGES_PER_CELL = 4
CELLS_ACROSS = 512


def clip(image: DataFrame, ring_list: list[list[tuple[float, float]]]) -> DataFrame:
    """Pixels whose centre lies inside one known polygon.

    The bounding box goes first as plain comparisons, which reach the scan.
    """
    lons = [p[0] for ring in ring_list for p in ring]
    lats = [p[1] for ring in ring_list for p in ring]
    lon, lat = F.col("lon"), F.col("lat")
    box = lon.between(min(lons), max(lons)) & lat.between(min(lats), max(lats))
    return image.filter(box & geo.inside_fixed(lon, lat, ring_list))


def named_boundary(regions: DataFrame, name: str) -> DataFrame:
    return regions.filter(F.col("name") == name)


def prepared(regions: DataFrame, keep: list[str]) -> DataFrame:
    """Regions with their edge list and bounding box."""
    edges = geo.edges(F.col("rings"))
    return regions.select(*keep, edges.alias("edges")).withColumns({
        "west": F.array_min(F.transform("edges", lambda e: e["x1"])), "east": F.array_max(F.transform("edges", lambda e: e["x1"])),
        "south": F.array_min(F.transform("edges", lambda e: e["y1"])), "north": F.array_max(F.transform("edges", lambda e: e["y1"])),
    })


EDGE = "array<struct<x1: double, y1: double, x2: double, y2: double>>"
COVER = f"_region long, fx int, fy int, whole boolean, odd boolean, near {EDGE}, flips array<double>"


def cells_across(edges):
    """How many cells a region's box has on each side: about one for every ``EDGES_PER_CELL`` edges in all."""
    return F.least(F.lit(CELLS_ACROSS), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(edges) / F.lit(EDGES_PER_CELL))))).cast("int")


def cover(edges: np.ndarray, n: int) -> Iterator[tuple[int, int, bool, bool, list[tuple], list[float]]]:
    """Cells of an n x n grid over a polygon's box, without those that lie outside: fx, fy, whole, odd, near, flips.

    A cell no edge comes near is inside as a whole. Of any other, a point is inside if an odd number holds of:
    the ``near`` edges its ray to the east crosses, the ``flips`` not above it, and ``odd``. The last two stand
    for all edges east of the cell: such an edge is crossed between its lower and its upper end, so the ends
    that two edges share cancel, and what is left is where the outline enters or leaves that side.
    """
    west, east, south, north = edges[:, 0].min(), edges[:, 0].max(), edges[:, 1].min(), edges[:, 1].max()
    width, height = (east - west) / n or 1.0, (north - south) / n or 1.0
    loose = 1e-9 * max(east - west, north - south) + 1e-14 * np.abs(edges).max()
    edges = edges[edges[:, 1] != edges[:, 3]]
    low, high = edges[:, [1, 3]].min(1), edges[:, [1, 3]].max(1)
    left, right = edges[:, [0, 2]].min(1), edges[:, [0, 2]].max(1)
    first = np.clip(np.floor((left - loose - west) / width), 0, n - 1).astype(int)
    last = np.clip(np.floor((right + loose - west) / width), 0, n - 1).astype(int)
    bottom = np.clip(np.floor((low - loose - south) / height), 0, n - 1).astype(int)
    top = np.clip(np.floor((high + loose - south) / height), 0, n - 1).astype(int)
    rows: list[list[int]] = [[] for _ in range(n)]
    for k, (b, t) in enumerate(zip(bottom.tolist(), top.tolist(), strict=True)):
        for fy in range(b, t + 1):
            rows[fy].append(k)
    for fy, here in enumerate(rows):
        floor, near, beyond = south + fy * height - loose, [[] for _ in range(n)], [[] for _ in range(n + 1)]
        ceiling = floor + height + 2 * loose
        for k in here:
            beyond[first[k]].append(k)  # east of all cells before its first
            for fx in range(first[k], last[k] + 1):
                near[fx].append(k)
        odd, flips = False, set()
        for fx in range(n - 1, -1, -1):
            for k in beyond[fx + 1]:
                for end in (low[k], high[k]):
                    if end < floor:
                        odd = not odd
                    elif end <= ceiling:
                        flips ^= {float(end)}
            if near[fx] or flips:
                yield fx, fy, False, odd, [tuple(edges[k].tolist()) for k in near[fx]], sorted(flips)
            elif odd:
                yield fx, fy, True, True, [], []


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            region, n = batch.column("_region")[k].as_py(), batch.column("across")[k].as_py()
            flat = batch.column("edges")[k].values
            if flat is None or not len(flat):
                continue
            edges = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")])
            found = list(zip(*cover(edges, n), strict=True))
            if found:
                fx, fy, whole, odd, near, flips = found
                kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))
                listed = pa.array([[dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in cell] for cell in near], kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array([region] * len(fx), pa.int64()), pa.array(fx, pa.int32()), pa.array(fy, pa.int32()), pa.array(whole), pa.array(odd), listed, pa.array(flips, pa.list_(pa.float64()))],
                    names=["_region", "fx", "fy", "whole", "odd", "near", "flips"])


def locate(points: DataFrame, regions: DataFrame, keep: list[str], cell_deg: float = 0.1) -> DataFrame:
    """Each point with the region that contains it (inner join).

    Both sides meet on a coarse grid cell, so this is an equi join: a region's box, without its outline, is
    listed under the cells it covers, a point under its own. Points in the box then meet a finer grid of
    that region, as fine as its outline is long: its cells inside run no test, cells outside are not there,
    and border cells hold the edges that come near them and no others. ``cell_deg`` should be about the
    size of a region. An outline is worked on in one task.
    """
    boxed = cut_lineage(prepared(regions, keep).withColumns({"_region": F.monotonically_increasing_id(), "across": cells_across(F.col("edges"))}))
    fine = boxed.select("_region", "across", "edges").mapInArrow(_covers, COVER)

    def cells(low: str, high: str):
        return F.explode(F.sequence(F.floor(F.col(low) / cell_deg), F.floor(F.col(high) / cell_deg)))

    listed = boxed.drop("edges").withColumn("cell_x", cells("west", "east")).withColumn("cell_y", cells("south", "north"))
    placed = points.withColumns({"cell_x": F.floor(F.col("lon") / cell_deg), "cell_y": F.floor(F.col("lat") / cell_deg)})
    lon, lat, n = F.col("lon"), F.col("lat"), F.col("across")
    near = placed.join(listed, ["cell_x", "cell_y"]).filter(
        lon.between(F.col("west"), F.col("east")) & lat.between(F.col("south"), F.col("north"))
    )

    def cell(at, low: str, high: str):
        side = (F.col(high) - F.col(low)) / n
        return F.when(side > 0, F.least(n - 1, F.floor((at - F.col(low)) / side))).otherwise(0).cast("int")

    met = near.withColumns({"fx": cell(lon, "west", "east"), "fy": cell(lat, "south", "north")}).join(fine, ["_region", "fx", "fy"])
    flipped = F.size(F.filter("flips", lambda y: y <= lat)) % 2 == 1
    inside = (geo.inside(lon, lat, F.col("near")).cast("int") + flipped.cast("int") + F.col("odd").cast("int")) % 2 == 1
    return met.filter(F.col("whole") | inside).select(*[F.col(f"`{c}`") for c in points.columns], *keep)
