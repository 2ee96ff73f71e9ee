"""k-means of cell colours in Lab with CIEDE2000 assignment, one clustering an image.

Points are an image's distinct colours weighted by their cells: one for each cell of its grid at
most, 40 000 at the largest grid on offer.  So an image's points meet in one task, and all seeds
and rounds run there: one job for all images instead of several a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators import quantise
from tessella.operators.lineage import written
from tessella.operators.matching import LAB, dealt, nearest, nearest_of_own, with_palette_lab
from tessella.shipping import ship


def _with_races(points: DataFrame, k: int) -> DataFrame:
    """Points with -log(u) of a number u from 0 to 1 for every seed, by hashes."""
    chance = lambda step: (F.pmod(F.xxhash64(F.lit(step), "image_id", "r", "g", "b"), F.lit(2**40)) + 1) / F.lit(2.0**40 + 1)
    return points.withColumn("races", F.array(*(-F.log(chance(step)) for step in range(k))))


def _seeds(rgb: np.ndarray, lab: np.ndarray, w: np.ndarray, races: np.ndarray) -> np.ndarray:
    """The first centroids.  Each next one is drawn with a chance in proportion to its cells
    times the square of its distance from those before: of -log(u) / weight the smallest wins.
    A colour that is a centroid already has no chance."""
    weight, found = w.astype(float), []
    for step in range(races.shape[1]):
        open_ = np.flatnonzero(weight > 0)
        if not len(open_):
            break
        race = races[open_, step] / weight[open_]
        best = open_[np.lexsort((*rgb[open_].T[::-1], race))[0]]
        found.append(lab[best])
        nearer = w * quantise.delta_e(lab, lab[best]) ** 2
        weight = nearer if step == 0 else np.minimum(weight, nearer)
    return np.array(found).reshape(-1, 3)


def _lloyd(lab: np.ndarray, w: np.ndarray, centres: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, labels): a cluster without points keeps its centroid; the loop ends when no
    label changes."""
    labels = None
    for _ in range(most):
        now = quantise.delta_e(lab[:, None], centres[None]).argmin(1)  # the lowest of equals
        if labels is not None and (now == labels).all():
            break
        labels = now
        total = np.bincount(labels, w, len(centres))
        sums = np.stack([np.bincount(labels, w * lab[:, c], len(centres)) for c in range(3)], 1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], centres)
    return centres, labels


def _whole_images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole images with the rows at which they begin, from batches that are in the
    order of image_id: the last image of a batch may go on in the next."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        ids = rows["image_id"].to_numpy()
        begins = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        if len(begins) > 1:
            yield rows.slice(0, begins[-1]), begins[:-1]
        rest = rows.slice(begins[-1])
    if rest is not None:
        yield rest, np.array([0])


def _clustered(points: DataFrame, k: int, most: int) -> DataFrame:
    """Rows of centroids (image_id, label, p_l, p_a, p_b) and, after ``most`` rounds at most, of
    labels (image_id, r, g, b, label), which have no centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole_images(batches):
            column = lambda c: rows[c].to_numpy()
            rgb, lab, w = np.stack([column(c) for c in "rgb"], 1), np.stack([column(c) for c in LAB], 1), column("w")
            races = rows["races"].combine_chunks().flatten().to_numpy().reshape(-1, k)
            found, labels = [], []
            for part in map(slice, begins, [*begins[1:], rows.num_rows]):
                centres = _seeds(rgb[part], lab[part], w[part], races[part])
                if most:
                    centres, label = _lloyd(lab[part], w[part], centres, most)
                    labels.append(label)
                found.append(centres)
            sizes, centres = [len(x) for x in found], np.concatenate(found)
            none = lambda n, kind: [pa.nulls(n, kind)] * 3
            number = lambda xs: pa.array(np.concatenate(xs), pa.int32())
            ids = rows["image_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(begins, sizes))), *none(len(centres), pa.int32()), number([np.arange(n) for n in sizes]), *(pa.array(x) for x in centres.T)], names)
            if most:
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int32()) for x in rgb.T), number(labels), *none(len(ids), pa.float64())], names)

    names = ["image_id", "r", "g", "b", "label", "p_l", "p_a", "p_b"]
    ship(points.sparkSession)
    own = dealt(_with_races(points, k).select("image_id", "r", "g", "b", *LAB, "w", "races"), "image_id").sortWithinPartitions("image_id", "r", "g", "b")
    return own.mapInArrow(run, f"image_id {dict(points.dtypes)['image_id']}, r int, g int, b int, label int, p_l double, p_a double, p_b double")


def seeds(points: DataFrame, k: int) -> DataFrame:
    """The first centroids of each image, at most k: image_id, label, p_l, p_a, p_b."""
    return _clustered(points, k, 0).select("image_id", "label", "p_l", "p_a", "p_b")


def kmeans(cells: DataFrame, k: int, max_iterations: int = 30) -> tuple[DataFrame, DataFrame]:
    """(centroids, labels): (image_id, label, p_l, p_a, p_b) and (image_id, r, g, b, label)."""
    weights = cells.where(F.col("r").isNotNull()).groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("w"))
    found = written(_clustered(color.with_lab(weights), k, max_iterations))
    return found.where("p_l is not null").select("image_id", "label", "p_l", "p_a", "p_b"), found.where("p_l is null").select("image_id", "r", "g", "b", "label")


def _cluster_beads(centroids: DataFrame, palette: DataFrame) -> DataFrame:
    """image_id, label, brand, code, ord: the bead nearest to each centre."""
    centres = centroids.select("image_id", "label", *(F.col(f"p_{c[-1]}").alias(c) for c in LAB))
    return nearest(centres, palette, ("image_id", "label")).drop("delta_e")


def cluster_palettes(cells: DataFrame, palette: DataFrame, k: int, max_iterations: int = 30) -> DataFrame:
    """image_id, label, n, brand, code, ord: the bead nearest to each cluster's centre."""
    cells = written(cells)
    centroids, labels = kmeans(cells, k, max_iterations)
    sizes = cells.join(labels, ["image_id", "r", "g", "b"]).groupBy("image_id", "label").agg(F.count("*").alias("n"))
    return _cluster_beads(centroids, palette).join(sizes, ["image_id", "label"]).select("image_id", "label", "n", "brand", "code", "ord")


def cluster_quantise(cells: DataFrame, palette: DataFrame, k: int, max_iterations: int = 30, snap: bool = False, confetti_ratio: float = 0.0, dither: float = 0.0) -> DataFrame:
    """image_id, cx, cy, brand, code, ord, delta_e: each cell gets its cluster's bead.

    With ``dither`` or ``snap``, cells of images with two or more such beads are dithered or
    matched again among those, in the order of the clusters."""
    cells = written(cells)
    centroids, labels = kmeans(cells, k, max_iterations)
    own = written(_cluster_beads(centroids, palette))
    beads = cells.join(labels.join(own, ["image_id", "label"]), ["image_id", "r", "g", "b"], "left").select("image_id", "cx", "cy", "r", "g", "b", "brand", "code", "ord")
    if snap or dither > 0:
        reduced = own.groupBy("image_id", "ord", "brand", "code").agg(F.min("label").alias("rank")).join(with_palette_lab(palette).select("ord", *LAB), "ord")
        several = reduced.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select("image_id")
        chosen = cells.join(several, "image_id", "left_semi")
        if dither > 0:
            again = quantise.dithered(chosen, reduced, palette, dither)
        else:
            matched = nearest_of_own(chosen, reduced, F.col("rank")).drop("delta_e")
            again = chosen.join(matched, ["image_id", "r", "g", "b"], "left").select(*beads.columns)
        beads = beads.join(several, "image_id", "left_anti").unionByName(again)
    beads = written(beads)
    if confetti_ratio > 0:
        beads = written(quantise.clean_confetti(beads, palette, confetti_ratio))
    return quantise.with_distance(beads, palette).select("image_id", "cx", "cy", "brand", "code", "ord", "delta_e")
