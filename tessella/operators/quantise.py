"""Cells to beads of a reduced palette; confetti; dithering; counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators import matching
from tessella.operators.lineage import written
from tessella.operators.matching import LAB, nearest, nearest_of_own, with_palette_lab
from tessella.shipping import ship

BEADS = ("image_id", "cx", "cy", "brand", "code")


def reduced_palettes(cells: DataFrame, palette: DataFrame, max_colors: int) -> DataFrame:
    """Each image's most frequent nearest colours, first seen first among equals: image_id,
    rank, n, dropped (whether the image had more), brand, code, ord, Lab."""
    palette = with_palette_lab(palette)
    matched = cells.join(nearest(matching.distinct_colors(cells), palette), ["r", "g", "b"])
    counts = matched.groupBy("image_id", "ord").agg(F.count("*").alias("n"), F.min(F.struct("cy", "cx")).alias("first_seen"))
    by_count = Window.partitionBy("image_id").orderBy(F.desc("n"), "first_seen")  # one row a colour
    ranked = counts.withColumn("rank", F.row_number().over(by_count)).withColumn("dropped", F.count("*").over(Window.partitionBy("image_id")) > max(1, max_colors))
    return ranked.where(F.col("rank") <= max(1, max_colors)).join(palette.select("ord", "brand", "code", *LAB), "ord")


def quantise(cells: DataFrame, palette: DataFrame, max_colors: int, confetti_ratio: float = 0.0, dither: float = 0.0) -> DataFrame:
    """image_id, cx, cy, brand, code, ord, delta_e of every cell (null where the cell is).

    If an image has more nearest colours than ``max_colors``, all of its cells are matched
    again with its reduced palette, where ties go by rank; else by the palette's order.  With
    ``dither`` over 0, images of two or more reduced colours are dithered instead."""
    cells = written(cells)
    reduced = written(reduced_palettes(cells, palette, max_colors))
    tie = F.when(F.col("dropped"), F.col("rank")).otherwise(F.col("ord"))
    matched = nearest_of_own(cells, reduced, tie)
    beads = cells.join(matched, ["image_id", "r", "g", "b"], "left").select("image_id", "cx", "cy", "r", "g", "b", "brand", "code", "ord", "delta_e")
    if dither > 0:
        several = reduced.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select("image_id")
        rough = dithered(cells.join(several, "image_id", "left_semi"), reduced, palette, dither)
        beads = beads.join(several, "image_id", "left_anti").unionByName(with_distance(rough, palette))
    if confetti_ratio > 0:
        beads = with_distance(clean_confetti(written(beads), palette, confetti_ratio), palette)
    return beads.select("image_id", "cx", "cy", "brand", "code", "ord", "delta_e")


def with_distance(beads: DataFrame, palette: DataFrame) -> DataFrame:
    """Beads with the distance of their cell's colour (r, g, b) from their bead's."""
    side = with_palette_lab(palette).select("ord", *(F.col(c).alias(f"p_{c[-1]}") for c in LAB))
    pairs = color.with_lab(beads.where("ord is not null").select("r", "g", "b", "ord").distinct()).join(matching.small(side), "ord")
    measured = color.with_delta_e(pairs, LAB, ("p_l", "p_a", "p_b")).select("r", "g", "b", "ord", "delta_e")
    return beads.drop("delta_e").join(measured, ["r", "g", "b", "ord"], "left")


def clean_confetti(beads: DataFrame, palette: DataFrame, min_ratio: float) -> DataFrame:
    """Beads of colours below a share of the image's beads take the nearest colour that is
    not, the first seen of equals; nothing changes where all or none are below."""
    lab = with_palette_lab(palette).select("ord", "brand", "code", *LAB)
    counts = beads.where("ord is not null").groupBy("image_id", "ord").agg(F.count("*").alias("n"), F.min(F.struct("cy", "cx")).alias("first_seen"))
    kept = F.col("n") / F.sum("n").over(Window.partitionBy("image_id")) >= min_ratio  # one row a colour
    shares = counts.withColumn("kept", kept).join(lab.drop("brand", "code"), "ord")
    orphans = shares.where(~F.col("kept")).select("image_id", F.col("ord").alias("orphan"), *LAB)
    homes = shares.where("kept").select("image_id", "ord", "first_seen", *(F.col(c).alias(f"p_{c[-1]}") for c in LAB))
    pairs = color.with_delta_e(orphans.join(homes, "image_id"), LAB, ("p_l", "p_a", "p_b"))
    moved = pairs.groupBy("image_id", "orphan").agg(F.min(F.struct("delta_e", "first_seen", "ord")).alias("best")).select("image_id", F.col("orphan").alias("ord"), F.col("best.ord").alias("new"))
    new = beads.join(moved, ["image_id", "ord"], "left").withColumn("ord", F.coalesce("new", "ord")).drop("new", "brand", "code")
    return new.join(lab.select("ord", "brand", "code"), "ord", "left").select(*beads.columns)


def _lab(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255.0
    linear = np.where(c <= color.SRGB_LINEAR_FROM, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ np.array(color.RGB_TO_XYZ).T / np.array(color.WHITE)
    f = np.where(t > color.EPSILON, np.cbrt(t), (color.KAPPA * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def delta_e(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """CIEDE2000 of Lab triples, for the operators that work cell by cell."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(np.asarray(one, float), -1, 0), np.moveaxis(np.asarray(many, float), -1, 0)
    mean = (np.hypot(a1, b1) + np.hypot(a2, b2)) / 2
    g = 0.5 * (1 - np.sqrt(mean**7 / (mean**7 + 25.0**7)))
    a1, a2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    grey, d, s = c1 * c2 == 0, h2 - h1, h1 + h2
    dh = np.where(grey, 0.0, np.where(np.abs(d) <= 180, d, np.where(d > 180, d - 360, d + 360)))
    hm = np.where(grey, s, np.where(np.abs(d) <= 180, s / 2, np.where(s < 360, (s + 360) / 2, (s - 360) / 2)))
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    cos = lambda x: np.cos(np.radians(x))
    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.20 * cos(4 * hm - 63)
    dl = (l2 - l1) / (1 + 0.015 * (lm - 50) ** 2 / np.sqrt(20 + (lm - 50) ** 2))
    dc = (c2 - c1) / (1 + 0.045 * cm)
    dH = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(dh / 2)) / (1 + 0.015 * cm * t)
    rt = -2 * np.sqrt(cm**7 / (cm**7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((hm - 275) / 25) ** 2))))
    return np.sqrt(dl * dl + dc * dc + dH * dH + rt * dc * dH)


#: Where Floyd and Steinberg send a cell's error: dx, dy, sixteenths.
SPREAD = ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1))


def _dither(rgb: np.ndarray, shown: np.ndarray, palette_rgb: np.ndarray, palette_lab: np.ndarray, strength: float) -> np.ndarray:
    """Palette positions of one image's cells, -1 where none is shown."""
    height, width = shown.shape
    work, out = rgb.astype(float), np.full((height, width), -1)
    for y in range(height):
        for x in range(width):
            if not shown[y, x]:
                continue
            now = np.clip(work[y, x], 0, 255)
            best = int(np.argmin(delta_e(_lab(now), palette_lab)))
            out[y, x] = best
            error = (now - palette_rgb[best]) * strength
            for dx, dy, part in SPREAD:
                if 0 <= x + dx < width and y + dy < height and shown[y + dy, x + dx]:
                    work[y + dy, x + dx] += error * (part / 16)
    return out


def dithered(cells: DataFrame, reduced: DataFrame, palette: DataFrame, strength: float) -> DataFrame:
    """image_id, cx, cy, r, g, b, brand, code, ord by error diffusion.  Every cell depends on
    those before it, so an image's grid (bounded by the grid's size) is one group."""
    amount = min(1.0, max(0.0, strength))
    colors = reduced.select("image_id", "rank", "ord", "brand", "code").join(palette.select("ord", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb")), "ord").join(palette_lab(palette), "ord")

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(["cy", "cx"]), right.sort_values("rank")
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("image_id", "cx", "cy", "r", "g", "b", "brand", "code", "ord")})
        shape = (int(left["cy"].max()) + 1, int(left["cx"].max()) + 1)
        shown = left["r"].notna().to_numpy().reshape(shape)
        at = _dither(left[["r", "g", "b"]].fillna(0).to_numpy().reshape(*shape, 3), shown, right[["pr", "pg", "pb"]].to_numpy(float), right[["p_l", "p_a", "p_b"]].to_numpy(float), amount).reshape(-1)
        pick = lambda c: [right[c].iloc[k] if k >= 0 else None for k in at]
        return pd.DataFrame({"image_id": left["image_id"], "cx": left["cx"], "cy": left["cy"], **{c: left[c].astype("Int32") for c in "rgb"}, "brand": pick("brand"), "code": pick("code"), "ord": pd.array(pick("ord"), "Int32")})

    schema = "image_id long, cx int, cy int, r int, g int, b int, brand string, code string, ord int"
    ship(cells.sparkSession)
    colors = colors.withColumnRenamed("image_id", "for_image")
    return cells.select("image_id", "cx", "cy", "r", "g", "b").groupBy("image_id").cogroup(colors.groupBy("for_image")).applyInPandas(one, schema)


def palette_lab(palette: DataFrame) -> DataFrame:
    return with_palette_lab(palette).select("ord", *(F.col(c).alias(f"p_{c[-1]}") for c in LAB))


def counts(beads: DataFrame, first: bool = False) -> DataFrame:
    """image_id, brand, code, n; with ``first`` also the place (cy, cx) first seen."""
    seen = [F.min(F.struct("cy", "cx")).alias("first_seen")] * first
    return beads.where("code is not null").groupBy("image_id", "brand", "code").agg(F.count("*").alias("n"), *seen)


def summary(beads: DataFrame) -> DataFrame:
    """image_id, total, actual_colors, avg_delta_e (0 without beads)."""
    key = color.color_key(F.col("brand"), F.col("code"))
    return beads.groupBy("image_id").agg(F.count("code").alias("total"), F.countDistinct(key).alias("actual_colors"), F.coalesce(F.avg("delta_e"), F.lit(0.0)).alias("avg_delta_e"))
