"""Nearest palette colour by CIEDE2000, first of equals.

Distinct colours are matched, not cells: masking leaves a few thousand at most, and the match
is joined back on (r, g, b).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import color

#: A palette of more rows is not broadcast: the same plan then runs as a shuffled join.
BROADCAST_ROWS = 5_000
LAB = ("lab_l", "lab_a", "lab_b")
#: What a colour is known by, unless a caller's colours have another key.
RGB = ("r", "g", "b")


def with_palette_lab(palette: DataFrame) -> DataFrame:
    """A palette with Lab columns, computed where it has none."""
    return palette if set(LAB) <= set(palette.columns) else color.with_lab(palette)


def distinct_colors(cells: DataFrame) -> DataFrame:
    """r, g, b and Lab of the distinct non-null colours."""
    return color.with_lab(cells.where(F.col("r").isNotNull()).select("r", "g", "b").distinct())


def small(side: DataFrame) -> DataFrame:
    """``side``, marked for broadcast if its size, checked, allows it."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def _measured(pairs: DataFrame) -> DataFrame:
    return color.with_delta_e(pairs, LAB, ("p_l", "p_a", "p_b"))


def _side(palette: DataFrame, *columns: str) -> DataFrame:
    return palette.select(*columns, "brand", "code", "ord", *(F.col(c).alias(f"p_{c[-1]}") for c in LAB))


def dealt(colors: DataFrame, *by: str) -> DataFrame:
    """Colours dealt to all partitions: few rows, each of which meets a whole palette, so
    adaptive execution must not put them into one."""
    return colors.repartition(int(colors.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def nearest(colors: DataFrame, palette: DataFrame, key: tuple[str, ...] = RGB) -> DataFrame:
    """The key of colours (by default r, g, b) with brand, code, ord and delta_e of the nearest
    row of one palette.  Every colour is compared with every row of a palette that may be
    broadcast; of larger ones with those that its lightness allows (``nearest_pruned``)."""
    side = _side(with_palette_lab(palette))
    if side.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return nearest_pruned(colors, palette, key)
    return _best(_measured(dealt(colors).crossJoin(F.broadcast(side))), key)


def _best(pairs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    best = F.min(F.struct("delta_e", "ord", "brand", "code")).alias("best")
    return pairs.groupBy(*key).agg(best).select(*key, "best.brand", "best.code", "best.ord", "best.delta_e")


#: Sides of the cubes of Lab, fine to coarse, in which a colour looks for a first neighbour.
CUBES = (3.0, 6.0, 12.0, 24.0, 48.0)
#: CIEDE2000 divides the lightness difference by 1.747 at most (at L = 0 and 100), and the rest
#: of the sum of squares is never negative.
LIGHTNESS_DIVISOR = 1.75
#: Lightness of a bucket in which colours and palette rows meet.
STEP = 1.0


def _cubes(lab: tuple[str, str, str]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("cube"), *(F.floor(F.col(c) / size).cast("int").alias(f"at_{n}") for c, n in zip(lab, "lab", strict=True))) for k, size in enumerate(CUBES))))


def candidates(colors: DataFrame, side: DataFrame, key: tuple[str, ...] = RGB) -> DataFrame:
    """Pairs of a colour with each palette row that its lightness allows to be the nearest.

    A first bound comes from one row of each cube that the colour lies in and from one row of
    the whole palette.  Every row nearer than that bound lies within ``LIGHTNESS_DIVISOR`` times
    the bound in lightness, so the colour goes to the buckets of that range only."""
    reps = side.select(*(f"p_{c}" for c in "lab"), "ord", _cubes(("p_l", "p_a", "p_b")).alias("c")).select("c.*", "ord", *(f"p_{c}" for c in "lab"))
    reps = reps.groupBy("cube", "at_l", "at_a", "at_b").agg(F.min(F.struct("ord", "p_l", "p_a", "p_b")).alias("rep"))
    any_ = F.broadcast(side.agg(F.min(F.struct("ord", "p_l", "p_a", "p_b")).alias("any")))  # one row
    met = colors.select(*key, *LAB, _cubes(LAB).alias("c")).select(*key, *LAB, "c.*").join(reps, ["cube", "at_l", "at_a", "at_b"], "left").crossJoin(any_)
    one = F.coalesce("rep", "any")
    first = _measured(met.select(*key, *LAB, *(one[f"p_{c}"].alias(f"p_{c}") for c in "lab")))
    bounded = first.groupBy(*key, *LAB).agg(F.min("delta_e").alias("bound"))
    bounded = dealt(bounded, *key)
    reach = F.col("bound") * LIGHTNESS_DIVISOR + 1e-6
    low, high = (F.floor((F.col("lab_l") + by) / STEP) for by in (-reach, reach))
    asked = bounded.withColumn("reach", reach).withColumn("bucket", F.explode(F.sequence(F.greatest(low, F.lit(-1)), F.least(high, F.lit(int(100 / STEP) + 1)))))
    placed = side.withColumn("bucket", F.floor(F.col("p_l") / STEP))
    return asked.join(small(placed), "bucket").where(F.abs(F.col("lab_l") - F.col("p_l")) <= F.col("reach"))


def nearest_pruned(colors: DataFrame, palette: DataFrame, key: tuple[str, ...] = RGB) -> DataFrame:
    """``nearest`` for a palette of any size: a join on buckets of lightness, shuffled if the
    palette has many colours.  Of palette rows of one colour only the first is kept."""
    side = _side(with_palette_lab(palette))
    same = side.groupBy("p_l", "p_a", "p_b").agg(F.min(F.struct("ord", "brand", "code")).alias("first"))
    side = same.select("first.*", "p_l", "p_a", "p_b")
    return _best(_measured(candidates(colors, side, key)), key)


def nearest_of_own(cells: DataFrame, palettes: DataFrame, tie: Column) -> DataFrame:
    """image_id, r, g, b with the nearest row of each image's own palette (image_id, palette
    columns), ties by ``tie``."""
    own = color.with_lab(dealt(cells.where(F.col("r").isNotNull()).select("image_id", "r", "g", "b").distinct(), "image_id"))
    side = palettes.select("image_id", "brand", "code", "ord", tie.alias("tie"), *(F.col(c).alias(f"p_{c[-1]}") for c in LAB))
    pairs = _measured(own.join(side, "image_id"))
    best = F.min(F.struct("delta_e", "tie", "ord", "brand", "code")).alias("best")
    return pairs.groupBy("image_id", "r", "g", "b").agg(best).select("image_id", "r", "g", "b", "best.brand", "best.code", "best.ord", "best.delta_e")
