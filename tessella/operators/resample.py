"""Resampling by a windowed sinc: two passes, one an axis, as rows.

Each pixel goes to the targets whose kernel reaches it, with its weight; sums of a target are
made on the map side first, so what is shuffled is about the target's size, and no task holds an
image.  A kernel is stretched where the image shrinks, beyond the border the last pixel counts
on, and weights are normed to a sum of 1.  Colours are weighted by their alpha.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import clamp, half_up
from tessella.operators.geometry import sized

#: Decimals that a sum is rounded to before it becomes a channel, so that the order in which
#: doubles were added doesn't show.
DECIMALS = 6


def _sinc(t: Column) -> Column:
    x = t * math.pi
    return F.when(t == 0, 1.0).otherwise(F.sin(x) / x)


def lanczos(t: Column, lobes: int = 3) -> Column:
    """The kernel at ``t``: sinc(t) sinc(t / lobes) within the lobes, else 0."""
    return F.when(F.abs(t) < lobes, _sinc(t) * _sinc(t / F.lit(float(lobes)))).otherwise(0.0)


def _axis(rows: DataFrame, at: str, side: str, n: int, virtual: Column, lobes: int, sums: tuple[str, ...]) -> DataFrame:
    """``rows`` resampled along the axis ``at`` of length ``side`` to the middle ``n`` of
    ``virtual`` places; ``sums`` are the columns to add up, by all others."""
    rest = [c for c in rows.columns if c not in (at, *sums)]
    plan = rows.withColumn("virtual", virtual)
    plan = plan.withColumn("ratio", F.col(side) / F.col("virtual")).withColumn("off", F.floor((F.lit(n) - F.col("virtual")) / 2.0))
    stretch = F.greatest(F.lit(1.0), F.col("ratio"))
    plan = plan.withColumn("support", stretch * float(lobes))
    more = F.ceil("support")
    first, last = F.when(F.col(at) == 0, -more).otherwise(F.col(at)), F.when(F.col(at) == F.col(side) - 1, F.col(at) + more).otherwise(F.col(at))
    plan = plan.withColumn("tap", F.explode(F.sequence(first, last)))
    place = lambda source: (source + 0.5) / F.col("ratio") - 0.5 + F.col("off")
    low = F.greatest(F.lit(0), F.ceil(place(F.col("tap") - F.col("support"))))
    high = F.least(F.lit(n - 1), F.floor(place(F.col("tap") + F.col("support"))))
    plan = plan.withColumns({"low": low, "high": high}).where("low <= high").withColumn("target", F.explode(F.sequence("low", "high")))
    centre = (F.col("target") - F.col("off") + 0.5) * F.col("ratio") - 0.5
    plan = plan.withColumn("weight", lanczos((F.col("tap") - centre) / stretch, lobes))
    added = plan.groupBy(*rest, F.col("target").cast("int").alias(at)).agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in sums), F.sum("weight").alias("weight"))
    return added.select(*rest, at, *((F.col(c) / F.col("weight")).alias(c) for c in sums))


def resize_lanczos(pixels: DataFrame, width: int, height: int, lobes: int = 3) -> DataFrame:
    """Pixels of width x height that each image covers, centred, what is over cut off."""
    own = sized(pixels).select("image_id", "x", "y", "width", "height", F.col("a").cast("double").alias("a"), *((F.col(c) * F.col("a")).cast("double").alias(c) for c in "rgb"))
    scale = F.greatest(F.lit(float(width)) / F.col("width"), F.lit(float(height)) / F.col("height"))
    virtual = lambda side: F.greatest(F.lit(1), half_up(F.col(side) * scale))
    down = _axis(own, "y", "height", height, virtual("height"), lobes, ("r", "g", "b", "a"))
    both = _axis(down, "x", "width", width, virtual("width"), lobes, ("r", "g", "b", "a"))
    channel = lambda v: half_up(clamp(F.round(v, DECIMALS)))
    alpha = F.col("a")
    colours = (F.when(F.round(alpha, DECIMALS) > 0, channel(F.col(c) / alpha)).otherwise(0).alias(c) for c in "rgb")
    return both.select("image_id", "x", "y", *colours, channel(alpha).alias("a"), F.lit(width).alias("width"), F.lit(height).alias("height"))
