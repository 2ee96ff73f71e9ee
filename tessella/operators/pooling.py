"""From pixels to cells: mode, mean and alpha pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import half_up
from tessella.operators.geometry import sized


def _owner(at: str, side: str, n: int) -> Column:
    """The cell among ``n`` whose [floor(g s), floor((g + 1) s)) holds a pixel, s = side / n:
    the largest g with floor(g s) <= at.  In whole numbers that is ((at + 1) n - 1) div side; as
    doubles, the next cell may begin a pixel earlier, where g s is a whole number rounded down."""
    g = F.expr(f"cast((({at} + 1) * {n} - 1) div {side} as int)")
    return g + (F.floor((g + 1) * (F.col(side) / F.lit(float(n)))) <= F.col(at)).cast("int")


def mode_downsample(pixels: DataFrame, width: int, height: int, fg_threshold: float = 0.4, mask: int = 0xF8) -> DataFrame:
    """image_id, cx, cy, r, g, b: the most frequent masked colour of each cell's opaque pixels,
    the first seen of equals; null where too small a share is opaque."""
    placed = sized(pixels).select(
        "image_id",
        _owner("x", "width", width).alias("cx"),
        _owner("y", "height", height).alias("cy"),
        (F.col("y") * F.col("width") + F.col("x")).alias("seq"),
        (F.col("a") >= 128).alias("opaque"),
        *(F.when(F.col("a") >= 128, F.col(c).bitwiseAND(F.lit(mask))).alias(c) for c in "rgb"),
    )
    by_color = placed.groupBy("image_id", "cx", "cy", "opaque", "r", "g", "b").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    opaque = F.col("opaque")
    best = F.min(F.when(opaque, F.struct((-F.col("n")).alias("less"), "first", "r", "g", "b")))
    cells = by_color.groupBy("image_id", "cx", "cy").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(opaque, F.col("n"))), F.lit(0)).alias("fg"), best.alias("best"))
    shown = F.col("fg") / F.col("total") >= fg_threshold
    cells = cells.select("image_id", "cx", "cy", *(F.when(shown, F.col(f"best.{c}")).alias(c) for c in "rgb"))
    images = pixels.select("image_id").distinct()
    grid = images.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return grid.join(cells, ["image_id", "cx", "cy"], "left")  # a border pixel that no cell owns lies outside the grid


def _windows(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels with the cells whose window they lie in.  Windows overlap where the ratio is no
    whole number: a pixel is in those g with floor(g s) <= at < (g + 1) s."""

    def owners(at: str, side: str, n: int) -> Column:
        s = F.col(side) / F.lit(float(n))
        guess = F.floor(F.col(at) / s).cast("int")
        near = F.sequence(F.greatest(F.lit(0), guess - 1), F.least(F.lit(n - 1), F.floor((F.col(at) + 1) / s).cast("int") + 1))
        return F.filter(near, lambda g: (F.floor(g * s) <= F.col(at)) & (F.col(at) < F.least(F.col(side), (g + 1) * s)))

    rows = sized(pixels).withColumn("cx", F.explode(owners("x", "width", width)))
    return rows.withColumn("cy", F.explode(owners("y", "height", height)))


def area_downsample(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, cx, cy and the mean colour of each cell's window."""
    return _windows(pixels, width, height).groupBy("image_id", "cx", "cy").agg(*(half_up(F.avg(c)).alias(c) for c in "rgb"))


def alpha_downsample(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, cx, cy and the mean alpha of each cell's window."""
    return _windows(pixels, width, height).groupBy("image_id", "cx", "cy").agg(half_up(F.avg("a")).alias("a"))


def foreground_ratio(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, cx, cy, fg, total of each cell that owns pixels."""
    placed = sized(pixels).select("image_id", "a", _owner("x", "width", width).alias("cx"), _owner("y", "height", height).alias("cy"))
    placed = placed.where(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1))
    return placed.groupBy("image_id", "cx", "cy").agg(F.count_if(F.col("a") >= 128).alias("fg"), F.count("*").alias("total"))
