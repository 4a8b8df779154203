"""Render grids and tile boxes of areas of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.functions import geo
from landsift.session import cut_lineage


def render_grid(boxes: DataFrame, ground_m: float = 10.0) -> DataFrame:
    """Pixel grid per bounding box (west, south, east, north columns).

    The Mercator step is chosen so that one pixel is ``ground_m`` on the ground;
    bounds are snapped to where whole pixels end, anchored at the top left.
    """
    sized = boxes.withColumns({
        "merc_scale": geo.mercator_scale(F.col("south"), F.col("north"), ground_m),
        "x0": geo.mercator_x(F.col("west")), "x1": geo.mercator_x(F.col("east")),
        "y0": geo.mercator_y(F.col("south")), "y1": geo.mercator_y(F.col("north")),
    }).withColumns({
        "width": geo.pixel_span(F.col("x0"), F.col("x1"), F.col("merc_scale")),
        "height": geo.pixel_span(F.col("y0"), F.col("y1"), F.col("merc_scale")),
    })
    return sized.withColumns({
        "east": geo.inverse_mercator_x(F.col("x0") + F.col("width") * F.col("merc_scale")),
        "south": geo.inverse_mercator_y(F.col("y1") - F.col("height") * F.col("merc_scale")),
    }).drop("x1", "y0")


TILES_A_TASK = 200_000


def dealt(grids: DataFrame, tile_px: int, by: list[str]) -> DataFrame:
    """The grids over as many tasks as their tiles need. A small file of grids is one task and yields very many tiles."""
    grids = cut_lineage(grids)
    tiles = F.ceil(F.col("width") / tile_px) * F.ceil(F.col("height") / tile_px)
    total = grids.agg(F.sum(tiles)).first()[0] or 0
    return grids.repartition(max(1, -(-int(total) // TILES_A_TASK)), *by)


def tile_boxes(grids: DataFrame, tile_px: int = S.TILE_PX, pad_px: int = S.EDGE_PAD_PX, by: list[str] | None = None) -> DataFrame:
    """Every tile of every grid with its pixel box, its region and the padded region; grids equal in ``by`` stay in one task."""
    cut = dealt(grids, tile_px, by or []).withColumn("top", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(tile_px)))).withColumn(
        "left", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(tile_px)))
    ).withColumns({
        "right": F.least(F.col("left") + tile_px, F.col("width")),
        "bottom": F.least(F.col("top") + tile_px, F.col("height")),
    })
    step = F.col("merc_scale")
    regions = cut.withColumns({
        "tile_west": geo.inverse_mercator_x(F.col("x0") + F.col("left") * step),
        "tile_south": geo.inverse_mercator_y(F.col("y1") - F.col("bottom") * step),
        "tile_east": geo.inverse_mercator_x(F.col("x0") + F.col("right") * step),
        "tile_north": geo.inverse_mercator_y(F.col("y1") - F.col("top") * step),
    })
    pad_x = (F.col("tile_east") - F.col("tile_west")) * pad_px / F.greatest(F.lit(1), F.col("right") - F.col("left"))
    pad_y = (F.col("tile_north") - F.col("tile_south")) * pad_px / F.greatest(F.lit(1), F.col("bottom") - F.col("top"))
    return regions.withColumns({
        "pad_west": F.col("tile_west") - pad_x, "pad_south": F.col("tile_south") - pad_y,
        "pad_east": F.col("tile_east") + pad_x, "pad_north": F.col("tile_north") + pad_y,
    })


def assign_tiles(pixels: DataFrame, tile_px: int = S.TILE_PX) -> DataFrame:
    return pixels.withColumns({
        "tile_x": F.floor(F.col("x") / tile_px).cast("long"), "tile_y": F.floor(F.col("y") / tile_px).cast("long")
    })


def tile_invariants(tiles: DataFrame, key: str) -> DataFrame:
    """Per grid: tile areas add up to the grid and the tiles reach all its edges."""
    area = (F.col("right") - F.col("left")).cast("long") * (F.col("bottom") - F.col("top"))
    return tiles.groupBy(key).agg(
        F.count("*").alias("tiles"), F.sum(area).alias("tile_pixels"),
        F.max(F.col("width").cast("long") * F.col("height")).alias("grid_pixels"),
        (F.max("right") == F.max("width")).alias("reaches_right"), (F.max("bottom") == F.max("height")).alias("reaches_bottom"),
        F.count_distinct("left", "top").alias("corners"),
    ).withColumn("exact", (F.col("tile_pixels") == F.col("grid_pixels")) & (F.col("corners") == F.col("tiles")))
