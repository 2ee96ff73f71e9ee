"""Pixel operators: posterising, edges, smoothing, background removal."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators.geometry import sized
from tessella.operators.tiles import TILE, map_tiles
from tessella.shipping import ship

#: The Sobel kernels by offset.
SOBEL = [(dx, dy, dx * (2 - abs(dy)), dy * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def posterize(pixels: DataFrame, levels: int = 8) -> DataFrame:
    """Channels of opaque pixels on ``levels`` evenly spaced values."""
    return pixels.withColumns({c: F.when(F.col("a") < 128, F.col(c)).otherwise(color.posterize_channel(F.col(c), levels)) for c in ("r", "g", "b")})


def mask(pixels: DataFrame, bits: int = 0xF8) -> DataFrame:
    return pixels.withColumns({c: color.mask_channel(F.col(c), bits) for c in ("r", "g", "b")})


def tone(pixels: DataFrame, gains: tuple[float, float, float], offsets: tuple[float, float, float]) -> DataFrame:
    """Each channel times its gain plus its offset, rounded and clamped."""
    return pixels.withColumns({c: color.half_up(color.clamp(F.col(c) * gain + offset)) for c, gain, offset in zip("rgb", gains, offsets, strict=True)})


def modulate(pixels: DataFrame, brightness: float = 1.0, saturation: float = 1.0, hue: float = 0.0, lightness: float = 0.0) -> DataFrame:
    """Lightness times ``brightness`` plus ``lightness``, chroma times ``saturation`` and hue
    turned by ``hue`` degrees, in the cylinder over CIELAB (LCh); channels out of gamut are
    clamped."""
    lab = color.with_lab(pixels)
    a, b = F.col("lab_a"), F.col("lab_b")
    chroma, angle = F.sqrt(a * a + b * b) * saturation, F.atan2(b, a) + math.radians(hue)
    moved = lab.withColumns({"lab_l": F.col("lab_l") * brightness + lightness, "lab_a": chroma * F.cos(angle), "lab_b": chroma * F.sin(angle)})
    back = color.with_rgb(moved).drop("lab_l", "lab_a", "lab_b")
    return back.withColumns({c: color.clamp(F.col(c)).cast("int") for c in "rgb"}).select(*pixels.columns)


def low_res_cells(pixels: DataFrame, levels: int = 10) -> DataFrame:
    """Every pixel as a cell of its own, its channels on ``levels`` values."""
    return pixels.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), *(color.clamp(color.posterize_channel(F.col(c), levels)).cast("int").alias(c) for c in "rgb"))


def _sobel(grey: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    """Magnitudes of the gradient, a shift of the whole tile at a time."""
    height, width = there.shape[0] - 2, there.shape[1] - 2
    gx, gy = np.zeros((height, width)), np.zeros((height, width))
    for dx, dy, wx, wy in SOBEL:
        near = grey[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width, 0]
        gx += near * wx
        gy += near * wy
    return {"magnitude": np.sqrt(gx * gx + gy * gy)}


def gradients(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """image_id, x, y, magnitude of the luma gradient of all pixels off the border."""
    pixels = sized(pixels)
    grey = pixels.select("image_id", "x", "y", "width", "height", color.grey(F.col("r"), F.col("g"), F.col("b"), F.col("a")).alias("grey"))
    found = map_tiles(grey, ("grey",), 1, _sobel, "magnitude double", tile)
    inner = F.col("x").between(1, F.col("width") - 2) & F.col("y").between(1, F.col("height") - 2)
    return found.where(inner).select("image_id", "x", "y", "magnitude")


def enhance_edges(pixels: DataFrame, threshold: float = 90, darken: float = 0.55) -> DataFrame:
    """Opaque pixels whose gradient is over ``threshold``, darkened by a factor of 0 to 1."""
    factor = min(1.0, max(0.0, darken))
    edges = gradients(pixels).where(F.col("magnitude") > threshold).select("image_id", "x", "y", F.lit(True).alias("edge"))
    marked = pixels.join(edges, ["image_id", "x", "y"], "left")
    on = F.col("edge").isNotNull() & (F.col("a") >= 128)
    return marked.withColumns({c: F.when(on, color.half_up(F.col(c) * factor)).otherwise(F.col(c)) for c in ("r", "g", "b")}).select(*pixels.columns)


def _smooth(values: np.ndarray, there: np.ndarray, sigma_space: float, sigma_color: float) -> dict[str, np.ndarray]:
    """Weighted means of a tile's neighbourhoods, a shift of the whole tile at a time."""
    radius = math.ceil(sigma_space * 2)
    height, width = there.shape[0] - 2 * radius, there.shape[1] - 2 * radius
    inner = (slice(radius, radius + height), slice(radius, radius + width))
    rgb, own = values[..., :3], values[inner][..., :3]
    sums, weights = np.zeros(own.shape), np.zeros(own.shape[:2])
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            at = (slice(radius + dy, radius + dy + height), slice(radius + dx, radius + dx + width))
            w = math.exp(-(dx * dx + dy * dy) / (2.0 * sigma_space * sigma_space)) * np.exp(-((own - rgb[at]) ** 2).sum(-1) / (2.0 * sigma_color * sigma_color))
            w = w * there[at]
            sums += rgb[at] * w[..., None]
            weights += w
    out = np.floor(sums / np.where(there[inner], weights, 1.0)[..., None] + 0.5).astype(np.int32)
    return {**{c: out[..., k] for k, c in enumerate("rgb")}, "a": values[inner][..., 3].astype(np.int32)}


def bilateral(pixels: DataFrame, sigma_space: float, sigma_color: float, tile: int = TILE) -> DataFrame:
    """Edge-keeping smoothing over (2 ceil(2 sigma_space) + 1) squared neighbours, the border
    repeated outwards; missing pixels weigh nothing.  As rows, each pixel would meet all of its
    neighbours in a shuffle of 25 times the table at a ``sigma_space`` of 1."""
    work = functools.partial(_smooth, sigma_space=sigma_space, sigma_color=sigma_color)
    return map_tiles(pixels, ("r", "g", "b", "a"), math.ceil(sigma_space * 2), work, "r int, g int, b int, a int", tile)


def _flood(data: np.ndarray, alpha: np.ndarray, tolerance: float) -> np.ndarray:
    """New alpha of one image: depth-first from all border pixels, each path keeping the
    colour it began with; a pixel belongs to the first path that reaches it."""
    height, width = alpha.shape
    reached = np.zeros((height, width), bool)
    stack: list[tuple[int, int, np.ndarray]] = []

    def reach(y: int, x: int, seed: np.ndarray) -> None:
        if 0 <= y < height and 0 <= x < width and not reached[y, x] and np.abs(data[y, x] - seed).sum() <= 3 * tolerance:
            reached[y, x] = True
            stack.append((y, x, seed))

    border = [(y, x) for x in range(width) for y in (0, height - 1)] + [(y, x) for y in range(height) for x in (0, width - 1)]
    for y, x in border:
        reach(y, x, data[y, x])
    while stack:
        y, x, seed = stack.pop()
        for ny, nx in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
            reach(ny, nx, seed)
    opaque = alpha >= 128
    cleared = int((opaque & reached).sum())
    if not opaque.any() or cleared / int(opaque.sum()) > 0.98:
        return alpha
    return np.where(reached, 0, alpha)


def flood_fill_background(pixels: DataFrame, tolerance: float = 32) -> DataFrame:
    """The background, reached from the border, made transparent, unless that would take more
    than 98 % of the opaque pixels.  Which path owns a pixel depends on the order, so an image
    is one group (bounded by the intake's size limit)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        shape = (int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1)
        if len(pdf) != shape[0] * shape[1]:
            raise ValueError("an image lacks pixels")
        alpha = _flood(pdf[["r", "g", "b"]].to_numpy(np.int64).reshape(*shape, 3), pdf["a"].to_numpy().reshape(shape), tolerance)
        return pdf.assign(a=alpha.reshape(-1).astype(np.int32))

    ship(pixels.sparkSession)
    own = sized(pixels).select("image_id", "x", "y", "r", "g", "b", "a", "width", "height")
    return own.groupBy("image_id").applyInPandas(one, own.schema)
