"""Boards: counts of each colour for a board and for the whole grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.color import color_key


def with_board(beads: DataFrame, size: int) -> DataFrame:
    """Beads with the board they lie on: an equi-key instead of a range join."""
    size = max(1, int(size))
    cols = beads.groupBy("image_id").agg(F.ceil((F.max("cx") + 1) / F.lit(float(size))).cast("int").alias("__cols"))
    row, col = F.floor(F.col("cy") / size), F.floor(F.col("cx") / size)
    return beads.join(cols, "image_id").withColumn("board_index", (row * F.col("__cols") + col).cast("int")).drop("__cols")


def color_stats(beads: DataFrame, palette: DataFrame, size: int, board: int | None = None) -> DataFrame:
    """image_id, color_key, brand, code, total, board_count of the palette colours that an
    image uses; board_count is that of one board, or the total without one."""
    used = with_board(beads.where("code is not null"), size)
    on = F.lit(True) if board is None else F.col("board_index") == board
    n = used.groupBy("image_id", "brand", "code").agg(F.count("*").alias("total"), F.count_if(on).alias("board_count"))
    found = palette.select("brand", "code").distinct().join(n, ["brand", "code"], "left").where("total > 0")
    return found.select("image_id", color_key(F.col("brand"), F.col("code")).alias("color_key"), "brand", "code", "total", "board_count")


def ranked(stats: DataFrame) -> DataFrame:
    """Stats with their place by total, then key (in the order of Unicode collation, not of
    bytes), and by board count."""
    key = F.collate(F.col("color_key"), "UNICODE")
    total = Window.partitionBy("image_id").orderBy(F.desc("total"), key)  # one row a colour
    board = Window.partitionBy("image_id").orderBy(F.desc("board_count"), F.desc("total"), key)
    return stats.withColumns({"by_total": F.row_number().over(total), "by_board": F.row_number().over(board)})


def row_counts(beads: DataFrame, row: int) -> DataFrame:
    """image_id, brand, code, n, first_x of one row of beads; reports order by n desc, first_x."""
    return beads.where((F.col("cy") == row) & F.col("code").isNotNull()).groupBy("image_id", "brand", "code").agg(F.count("*").alias("n"), F.min("cx").alias("first_x"))


def board_totals(beads: DataFrame, size: int) -> DataFrame:
    """image_id, board_index, beads."""
    return with_board(beads, size).groupBy("image_id", "board_index").agg(F.count("code").alias("beads"))


def remaining(beads: DataFrame, done: DataFrame) -> DataFrame:
    """Beads whose cell (image_id, cx, cy) isn't in the table of those done."""
    return beads.where("code is not null").join(done, ["image_id", "cx", "cy"], "left_anti")
