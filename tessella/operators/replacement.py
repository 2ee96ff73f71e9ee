"""Swapping colours of finished patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import color_key


def replace_colors(beads: DataFrame, replacements: DataFrame) -> DataFrame:
    """Beads with replacements (color_key, brand, code) applied once, not in chains."""
    swap = replacements.select(F.col("color_key").alias("__key"), F.col("brand").alias("__brand"), F.col("code").alias("__code"))
    out = beads.join(swap, color_key(F.col("brand"), F.col("code")) == F.col("__key"), "left")
    return out.withColumns({"brand": F.coalesce("__brand", "brand"), "code": F.coalesce("__code", "code")}).select(*beads.columns)


def replacement_stats(beads: DataFrame, replacements: DataFrame, before: DataFrame) -> DataFrame:
    """image_id, total, actual_colors, avg_delta_e after replacement; the last is what it was
    (``before`` is a summary), as it isn't measured again."""
    after = replace_colors(beads, replacements)
    n = after.groupBy("image_id").agg(F.count("code").alias("total"), F.countDistinct(color_key(F.col("brand"), F.col("code"))).alias("actual_colors"))
    return n.join(before.select("image_id", "avg_delta_e"), "image_id")
