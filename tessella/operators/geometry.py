"""Cropping, resampling and tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.color import half_up

CHANNELS = ("r", "g", "b", "a")
WORK_SCALE = 4


def sizes(pixels: DataFrame) -> DataFrame:
    """image_id, width, height."""
    if {"width", "height"} <= set(pixels.columns):
        return pixels.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def sized(pixels: DataFrame) -> DataFrame:
    """Pixels with their image's width and height: as the source gave them, else found by one
    more pass over the pixels."""
    return pixels if {"width", "height"} <= set(pixels.columns) else pixels.join(sizes(pixels), "image_id")


def foreground_bounds(pixels: DataFrame) -> DataFrame:
    """image_id, min_x, min_y, max_x, max_y of opaque pixels; images without any are left out."""
    opaque = pixels.where("a >= 128")
    return opaque.groupBy("image_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def trim_foreground(pixels: DataFrame) -> DataFrame:
    """Each image cut to its opaque part; images without one stay whole."""
    cut = sized(pixels).join(foreground_bounds(pixels), "image_id", "left")
    inside = F.col("min_x").isNull() | (F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
    x, y = F.col("x") - F.coalesce("min_x", F.lit(0)), F.col("y") - F.coalesce("min_y", F.lit(0))
    width = F.coalesce(F.col("max_x") - F.col("min_x") + 1, F.col("width"))
    height = F.coalesce(F.col("max_y") - F.col("min_y") + 1, F.col("height"))
    return cut.where(inside).select("image_id", x.alias("x"), y.alias("y"), *CHANNELS, width.alias("width"), height.alias("height"))


def _placed(pixels: DataFrame, width: Column, height: Column, x_from: Column, y_from: Column, x_to: Column, y_to: Column, plan: DataFrame, fill: tuple[int, int, int, int]) -> DataFrame:
    """Target pixels of [0, width) x [0, height), those between from and to taken from the
    source pixel that lies under them (scale, off_x, off_y in ``plan``)."""
    grid = plan.withColumn("x", F.explode(F.sequence(F.lit(0), width - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), height - 1)))
    drawn = F.col("x").between(x_from, x_to - 1) & F.col("y").between(y_from, y_to - 1)
    source = lambda c, off: F.when(drawn, F.floor((F.col(c) - F.col(off)) / F.col("scale")).cast("int"))
    target = grid.select("image_id", "x", "y", source("x", "off_x").alias("sx"), source("y", "off_y").alias("sy"), width.cast("int").alias("width"), height.cast("int").alias("height"))
    below = pixels.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *CHANNELS)
    found = target.join(below, ["image_id", "sx", "sy"], "left")
    return found.select("image_id", "x", "y", *(F.coalesce(F.col(c), F.lit(v)).cast("int").alias(c) for c, v in zip(CHANNELS, fill, strict=True)), "width", "height")


def resize(pixels: DataFrame, width: int, height: int, fit: str = "cover", fill: tuple[int, int, int, int] = (255, 255, 255, 255)) -> DataFrame:
    """Nearest-neighbour resize, centred, keeping proportions; 'cover' fills the target and
    cuts what is over, 'contain' shows the whole image on the fill colour."""
    by_x, by_y = F.lit(float(width)) / F.col("width"), F.lit(float(height)) / F.col("height")
    plan = sizes(pixels).withColumn("scale", F.greatest(by_x, by_y) if fit == "cover" else F.least(by_x, by_y))
    off = lambda side, c: F.floor((F.lit(side) - F.greatest(F.lit(1), half_up(F.col(c) * F.col("scale")))) / 2.0).cast("int")
    plan = plan.select("image_id", "scale", off(width, "width").alias("off_x"), off(height, "height").alias("off_y"))
    return _placed(pixels, F.lit(width), F.lit(height), F.lit(0), F.lit(0), F.lit(width), F.lit(height), plan, fill)


def bound_size(pixels: DataFrame, most: int = 512) -> DataFrame:
    """Images whose longer side is over ``most`` are scaled down to it, each side 1 at least."""
    plan = sizes(pixels).withColumn("scale", F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("width", "height")))
    side = lambda c: F.greatest(F.lit(1), half_up(F.col(c) * F.col("scale")))
    plan = plan.select("image_id", "scale", side("width").alias("w"), side("height").alias("h"), F.lit(0).alias("off_x"), F.lit(0).alias("off_y"))
    return _placed(pixels, F.col("w"), F.col("h"), F.lit(0), F.lit(0), F.lit(2**30), F.lit(2**30), plan, (0, 0, 0, 0))


def subject_fill(pixels: DataFrame, size: int, pad_ratio: float = 0.04) -> DataFrame:
    """The opaque part of each image, cut out and spread over a padded square; transparent
    outside."""
    trimmed = trim_foreground(pixels)
    pad = max(0, int(size * pad_ratio))
    inner = max(1, size - 2 * pad)
    plan = sizes(trimmed).withColumn("scale", F.greatest(F.lit(float(inner)) / F.col("width"), F.lit(float(inner)) / F.col("height")))
    off = lambda c: (F.lit(pad) + F.floor((F.lit(inner) - F.greatest(F.lit(1), half_up(F.col(c) * F.col("scale")))) / 2.0)).cast("int")
    plan = plan.select("image_id", "scale", off("width").alias("off_x"), off("height").alias("off_y"))
    return _placed(trimmed, F.lit(size), F.lit(size), F.lit(pad), F.lit(pad), F.lit(size - pad), F.lit(size - pad), plan, (0, 0, 0, 0))


def oriented(pixels: DataFrame, orientation: Column) -> DataFrame:
    """Pixels turned and mirrored upright from one of the eight orientations that cameras note
    (1: upright, also for any other value; 5 to 8 swap the sides)."""
    own = sized(pixels).withColumn("__turn", F.coalesce(orientation, F.lit(1)))
    turn, x, y = F.col("__turn"), F.col("x"), F.col("y")
    right, low = F.col("width") - 1 - x, F.col("height") - 1 - y
    new_x = F.when(turn.isin(2, 3), right).when(turn.isin(5, 8), y).when(turn.isin(6, 7), low).otherwise(x)
    new_y = F.when(turn.isin(3, 4), low).when(turn.isin(5, 6), x).when(turn.isin(7, 8), right).otherwise(y)
    lying = turn.between(5, 8)
    width, height = F.when(lying, F.col("height")).otherwise(F.col("width")), F.when(lying, F.col("width")).otherwise(F.col("height"))
    return own.select("image_id", new_x.alias("x"), new_y.alias("y"), *CHANNELS, width.alias("width"), height.alias("height"))


def full_canvas(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The working canvas of a whole image: four pixels a cell each way."""
    return resize(pixels, width * WORK_SCALE, height * WORK_SCALE, "cover")


def subject_canvas(pixels: DataFrame, width: int, height: int, detail: bool = False) -> DataFrame:
    """The working canvas of a cut-out subject, a square."""
    return subject_fill(pixels, max(width, height) * WORK_SCALE, 0.02 if detail else 0.04)


#: The sizes of boards to choose from.
BOARD_SIZES = (29, 57, 80)


def boards_of(grids: DataFrame, size: Column) -> DataFrame:
    """The boards that each grid (width, height and further columns) is split into, row by row;
    the last ones are cut.  A size below 1 counts as 1."""
    whole = grids.withColumn("__size", F.greatest(F.lit(1), size.cast("int")))
    whole = whole.withColumns({"__cols": F.ceil(F.col("width") / F.col("__size")).cast("int"), "__rows": F.ceil(F.col("height") / F.col("__size")).cast("int")})
    boards = whole.where("__cols > 0 and __rows > 0").withColumn("board_index", F.explode(F.sequence(F.lit(0), F.col("__cols") * F.col("__rows") - 1)))
    boards = boards.withColumns({"board_row": F.floor(F.col("board_index") / F.col("__cols")).cast("int"), "board_col": (F.col("board_index") % F.col("__cols")).cast("int")})
    x, y = F.col("board_col") * F.col("__size"), F.col("board_row") * F.col("__size")
    rest = [c for c in grids.columns if c not in ("width", "height")]
    return boards.select(*rest, "board_index", "board_row", "board_col", x.alias("x"), y.alias("y"), F.least("__size", F.col("width") - x).alias("width"), F.least("__size", F.col("height") - y).alias("height"))


def board_regions(spark: SparkSession, width: int, height: int, size: int) -> DataFrame:
    """``boards_of`` one grid."""
    return boards_of(spark.range(1).select(F.lit(width).alias("width"), F.lit(height).alias("height")), F.lit(size))


def cell_size(container: Column, cells: Column) -> Column:
    """Pixels of a cell, 12 to 30, so that a grid of so many cells and its labels fit into a
    container of at least 240 pixels inside its padding."""
    room = F.greatest(F.lit(240), container - 32)
    return F.greatest(F.lit(12), F.least(F.lit(30), F.floor((room - 28) / cells))).cast("int")


def progress(done: Column, total: Column) -> Column:
    """Whole percent, rounded half up; 0 of nothing."""
    return F.when(total > 0, half_up(done * 100 / total)).otherwise(0)
