"""Isolated beads take the colour that most of their neighbours have."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.shipping import ship

#: Neighbours in the order that breaks ties.
AROUND = ((0, -1), (0, 1), (-1, 0), (1, 0))


def _clean(keys: np.ndarray, passes: int) -> np.ndarray:
    """keys: numbers of colours, -1 for none.  Later cells see what earlier ones became."""
    out = keys.copy()
    height, width = out.shape
    for _ in range(passes):
        for y in range(height):
            for x in range(width):
                if out[y, x] < 0:
                    continue
                near = [out[y + dy, x + dx] for dy, dx in AROUND if 0 <= y + dy < height and 0 <= x + dx < width and out[y + dy, x + dx] >= 0]
                if near and out[y, x] not in near:
                    out[y, x] = Counter(near).most_common(1)[0][0]  # the first of equals
    return out


def clean_isolated(beads: DataFrame, passes: int = 2) -> DataFrame:
    """image_id, cx, cy, brand, code.  Cells are changed in place in row order, so an image's
    grid (bounded by the grid's size) is one group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cy", "cx"]).reset_index(drop=True)
        names = pdf["brand"].where(pdf["code"].isna(), pdf["brand"] + ":" + pdf["code"].fillna("")).where(pdf["code"].notna())
        numbers, uniques = pd.factorize(names)
        first = {k: int(np.flatnonzero(numbers == k)[0]) for k in range(len(uniques))}
        shape = (int(pdf["cy"].max()) + 1, int(pdf["cx"].max()) + 1)
        new = _clean(numbers.reshape(shape), passes).reshape(-1)
        pick = lambda c: [pdf[c].iloc[first[k]] if k >= 0 else None for k in new]
        return pdf.assign(brand=pick("brand"), code=pick("code"))

    ship(beads.sparkSession)
    own = beads.select("image_id", "cx", "cy", "brand", "code")
    return own.groupBy("image_id").applyInPandas(one, own.schema)


def clean_isolated_at_once(beads: DataFrame) -> DataFrame:
    """A different operator of the same purpose: all cells change at once, from the beads as
    they were.  One pass, without Python, for images of any size."""
    side = F.array(*(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(k).alias("k")) for k, (dy, dx) in enumerate(AROUND)))
    own = beads.where("code is not null").select("image_id", "cx", "cy", F.struct("brand", "code").alias("bead"))
    sent = own.select("image_id", F.explode(side).alias("s"), "cx", "cy", "bead").select("image_id", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), F.col("s.k").alias("k"), F.col("bead").alias("near"))
    votes = sent.groupBy("image_id", "cx", "cy", "near").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    best = votes.groupBy("image_id", "cx", "cy").agg(F.min(F.struct((-F.col("n")).alias("less"), "k", "near")).alias("best"), F.collect_set("near").alias("all"))
    met = own.join(best, ["image_id", "cx", "cy"])
    lone = met.where(~F.array_contains("all", F.col("bead"))).select("image_id", "cx", "cy", F.col("best.near").alias("new"))
    out = beads.join(lone, ["image_id", "cx", "cy"], "left")
    return out.select("image_id", "cx", "cy", F.coalesce("new.brand", "brand").alias("brand"), F.coalesce("new.code", "code").alias("code"))
