"""Stencils over images of any size: square tiles with a halo.

An image is cut into tiles; the pixels within ``radius`` of a tile's border go to the tiles
beside it too.  So one shuffle deals 1 + about 4 radius / ``TILE`` times the pixels, a tile is
worked on as arrays, and no task holds an image.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.geometry import sized
from tessella.shipping import ship

#: Pixels of a tile's side: 65 536 a tile.
TILE = 256


def _reached(at: str, side: str, radius: int, tile: int) -> Column:
    """The tiles along one axis that need a pixel."""
    last = F.floor((F.col(side) - 1) / tile)
    return F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - radius) / tile)), F.least(last, F.floor((F.col(at) + radius) / tile)))


def with_tiles(pixels: DataFrame, radius: int, tile: int) -> DataFrame:
    """Pixels with every tile (tx, ty) that needs them."""
    out = sized(pixels).withColumn("tx", F.explode(_reached("x", "width", radius, tile)))
    return out.withColumn("ty", F.explode(_reached("y", "height", radius, tile)))


def map_tiles(pixels: DataFrame, columns: tuple[str, ...], radius: int, work: Callable[[np.ndarray, np.ndarray], Mapping[str, np.ndarray]], made: str, tile: int = TILE) -> DataFrame:
    """image_id, x, y, width, height and what ``work`` makes of each tile's pixels.

    ``work(values, there)`` gets the channels ``columns`` (rows, columns, channels) and which
    pixels there are, both with ``radius`` more on each side, where an image's border is
    repeated outwards; it returns arrays of the tile without that halo, as ``made`` names and
    types them."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        width, height, tx, ty = (int(pdf[c].iloc[0]) for c in ("width", "height", "tx", "ty"))
        x0, y0 = tx * tile, ty * tile
        x1, y1 = min(width, x0 + tile), min(height, y0 + tile)
        left, top = max(0, x0 - radius), max(0, y0 - radius)
        shape = (min(height, y1 + radius) - top, min(width, x1 + radius) - left)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        values, there = np.zeros((*shape, len(columns))), np.zeros(shape, bool)
        values[y - top, x - left], there[y - top, x - left] = pdf[list(columns)].to_numpy(float), True
        rows = np.clip(np.arange(y0 - radius, y1 + radius), 0, height - 1) - top
        across = np.clip(np.arange(x0 - radius, x1 + radius), 0, width - 1) - left
        found = work(values[np.ix_(rows, across)], there[np.ix_(rows, across)])
        own = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
        x, y = x[own], y[own]
        return pd.DataFrame({"image_id": pdf["image_id"].to_numpy()[own], "x": x.astype(np.int32), "y": y.astype(np.int32), "width": np.int32(width), "height": np.int32(height), **{c: v[y - y0, x - x0] for c, v in found.items()}})

    ship(pixels.sparkSession)
    dealt = with_tiles(pixels, radius, tile).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "width", "height", "tx", "ty", *columns)
    return dealt.groupBy("image_id", "tx", "ty").applyInPandas(one, f"image_id {dict(pixels.dtypes)['image_id']}, x int, y int, width int, height int, {made}")
