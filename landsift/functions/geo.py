"""Coordinates, GeoJSON text, Web Mercator and polygon membership."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from landsift import schema as S

POSITION = r"\[\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
RINGS = "array<array<array<array<double>>>>"
SPHERE_M = 6371008.8


def block_id(lon: Column, lat: Column) -> Column:
    """One of ten groups of roughly 11 km cells."""
    return F.pmod(F.floor(lon * 10) * 31 + F.floor(lat * 10) * 17, F.lit(10)).cast("int")


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * S.EARTH_RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * S.EARTH_RADIUS_M


def inverse_mercator_x(x: Column) -> Column:
    return F.degrees(x / S.EARTH_RADIUS_M)


def inverse_mercator_y(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / S.EARTH_RADIUS_M)) - math.pi / 2)


def ground_width_m(west: Column, east: Column, south: Column, north: Column) -> Column:
    return (east - west) * S.METRES_PER_DEGREE * F.cos(F.radians((north + south) / 2))


def preview_pixels(width_m: Column) -> Column:
    low, high = S.PREVIEW_PX
    return F.greatest(F.lit(low), F.least(F.lit(high), (width_m / 10).cast("int")))


def mercator_scale(south: Column, north: Column, ground_m: float = 10.0) -> Column:
    return F.lit(ground_m) / F.cos(F.radians((north + south) / 2))


def pixel_span(low: Column, high: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.bround((high - low) / scale).cast("int"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * SPHERE_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


# ---- GeoJSON ----

def polygon_geometry(document: Column) -> Column:
    """Geometry text of the area: the first polygon of a feature collection, the
    geometry of a feature, or a bare geometry. Anything not a polygon is NULL."""
    feature = "struct<geometry:string>"
    kind = F.get_json_object(document, "$.type")
    features = F.from_json(F.get_json_object(document, "$.features"), f"array<{feature}>")

    def is_polygon(geometry: Column) -> Column:
        return F.get_json_object(geometry, "$.type").isin("Polygon", "MultiPolygon")

    first = F.get(F.filter(features, lambda f: is_polygon(f["geometry"])), F.lit(0))["geometry"]
    chosen = (
        F.when(kind == "FeatureCollection", first)
        .when(kind == "Feature", F.get_json_object(document, "$.geometry"))
        .otherwise(document)
    )
    return F.when(is_polygon(chosen), chosen)


def positions(geometry: Column) -> Column:
    """(lon, lat) pairs of a geometry at any nesting depth, in reading order."""
    text = F.get_json_object(geometry, "$.coordinates")
    lons = F.regexp_extract_all(text, F.lit(POSITION), 1)
    lats = F.regexp_extract_all(text, F.lit(POSITION), 2)
    return F.zip_with(
        lons, lats, lambda a, b: F.struct(a.cast("double").alias("lon"), b.cast("double").alias("lat"))
    )


def bounds(points: Column) -> Column:
    """Bounding box struct of an array of (lon, lat) pairs."""
    lon = F.transform(points, lambda p: p["lon"])
    lat = F.transform(points, lambda p: p["lat"])
    return F.struct(
        F.array_min(lon).alias("west"), F.array_min(lat).alias("south"),
        F.array_max(lon).alias("east"), F.array_max(lat).alias("north"),
    )


def rings(geometry: Column) -> Column:
    """All rings of a Polygon or MultiPolygon as arrays of [lon, lat]."""
    text = F.get_json_object(geometry, "$.coordinates")
    kind = F.get_json_object(geometry, "$.type")
    wrapped = F.when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return F.flatten(F.from_json(wrapped, RINGS))


def edges(ring_list: Column) -> Column:
    """Directed edges of all rings; an open ring is closed first."""
    def ring_edges(ring: Column) -> Column:
        closing = F.slice(ring, 1, 1)
        ends = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), closing)
        return F.zip_with(ring, ends, lambda a, b: F.struct(
            F.get(a, F.lit(0)).alias("x1"), F.get(a, F.lit(1)).alias("y1"),
            F.get(b, F.lit(0)).alias("x2"), F.get(b, F.lit(1)).alias("y2")))

    return F.flatten(F.transform(ring_list, ring_edges))


def crosses(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does the ray going east from the point cross this edge?"""
    spans = (y1 > lat) != (y2 > lat)
    return spans & (lon < F.try_divide((x2 - x1) * (lat - y1), y2 - y1) + x1)


def inside(lon: Column, lat: Column, edge_list: Column) -> Column:
    """Even-odd rule over the edges of every ring, so holes are excluded."""
    hits = F.filter(edge_list, lambda e: crosses(lon, lat, e["x1"], e["y1"], e["x2"], e["y2"]))
    return F.size(hits) % 2 == 1


def inside_fixed(lon: Column, lat: Column, ring_list: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule for one known polygon of any number of vertices.

    The box is cut into horizontal strips, as many as keep the listed edges
    below eight times their number; a point looks only at those of its strip.
    """
    edges = [
        (float(x1), float(y1), float(x2), float(y2))
        for ring in ring_list for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]) if y1 != y2
    ]
    if not edges:
        return F.lit(False)
    south, north = (f(y for e in edges for y in (e[1], e[3])) for f in (min, max))
    n = len(edges)
    while n > 1 and sum(abs(e[3] - e[1]) for e in edges) / (north - south) * n > 5 * len(edges):
        n //= 2
    height = (north - south) / n
    strips: list[list] = [[] for _ in range(n)]
    for e in edges:
        low, high = sorted(int((y - south) / height) for y in (e[1], e[3]))
        for k in range(max(low - 1, 0), min(high + 1, n - 1) + 1):  # one more on either side, for rounding
            strips[k].append(e)
    listed = F.from_json(F.lit(json.dumps(strips)), "array<array<array<double>>>")
    strip = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lat - south) / height))).cast("int")
    hits = F.filter(F.get(listed, strip), lambda e: crosses(lon, lat, e[0], e[1], e[2], e[3]))
    return F.size(hits) % 2 == 1
