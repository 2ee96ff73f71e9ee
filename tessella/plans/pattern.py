"""Photo to pattern: canvas, preprocessing, sampling, quantising, reports."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessella.operators import geometry, photo, pooling, quantise, render, resample
from tessella.operators.lineage import written
from tessella.plans.config import PRESETS, Config


def canvas(pixels: DataFrame, config: Config) -> DataFrame:
    if not PRESETS[config.pattern_mode].subject:
        return geometry.full_canvas(pixels, config.width, config.height)
    if config.flood_fill:
        pixels = photo.flood_fill_background(pixels, config.background_tolerance)
    return geometry.subject_canvas(pixels, config.width, config.height, config.detail_enhance)


def preprocess(pixels: DataFrame, config: Config) -> DataFrame:
    if config.posterize_levels > 0:
        pixels = photo.posterize(pixels, config.posterize_levels)
    if config.mode == "smart" and config.edge_threshold is not None and config.edge_darken is not None:
        pixels = photo.enhance_edges(pixels, config.edge_threshold, config.edge_darken)
    return pixels


def sample(pixels: DataFrame, config: Config) -> DataFrame:
    return pooling.mode_downsample(pixels, config.width, config.height, config.fg_threshold, config.mask)


def quantise_cells(cells: DataFrame, palette: DataFrame, config: Config) -> DataFrame:
    dither = config.dither_strength if config.dither else 0.0
    return quantise.quantise(cells, palette, config.max_colors, config.confetti_min_ratio, dither)


@dataclass
class Pattern:
    config: Config
    cells: DataFrame
    beads: DataFrame
    counts: DataFrame
    summary: DataFrame


def make_pattern(pixels: DataFrame, palette: DataFrame, config: Config) -> Pattern:
    """The sampled cells of every image, its beads, their counts and summary.  Cells and beads
    are written to the checkpoint folder once, and what is made of them reads them there."""
    config = config.resolved()
    return _of_cells(written(sample(preprocess(canvas(pixels, config), config), config)), palette, config)


#: The photo preset's gains and offsets.
BRIGHTNESS, SATURATION, GAINS, OFFSETS = 1.08, 1.22, (1.06, 1.02, 0.94), (10, 6, 0)
PHOTO_CONFETTI = 0.0015


def photo_cells(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Cells of upright photos: resampled to the grid's size, livened up, toned and posterised."""
    small = resample.resize_lanczos(pixels, width, height)
    return photo.low_res_cells(photo.tone(photo.modulate(small, BRIGHTNESS, SATURATION), GAINS, OFFSETS))


def make_photo_pattern(pixels: DataFrame, palette: DataFrame, size: int = 96, max_colors: int = 32) -> Pattern:
    """The pattern of photos whose every resampled pixel is a bead."""
    config = Config(size, size, max_colors=max_colors, dither=False, confetti_min_ratio=PHOTO_CONFETTI).resolved()
    return _of_cells(written(photo_cells(pixels, size, size)), palette, config)


def requantise(made: Pattern, palette: DataFrame, **changes) -> Pattern:
    """A pattern of the same cells with another palette or other settings of the quantiser
    (max_colors, dither, confetti_min_ratio): nothing is sampled again."""
    sampled = set(changes) - {"max_colors", "dither", "dither_strength", "confetti_min_ratio"}
    if sampled:
        raise ValueError(f"sampling depends on {sorted(sampled)}: make the pattern anew")
    return _of_cells(made.cells, palette, dataclasses.replace(made.config, **changes))


def _of_cells(cells: DataFrame, palette: DataFrame, config: Config) -> Pattern:
    beads = written(quantise_cells(cells, palette, config))
    return Pattern(config, cells, beads, quantise.counts(beads), quantise.summary(beads))


def preview(made: Pattern, palette: DataFrame, cell: int, labels: bool = True, round_: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, frame) of a pattern's drawing."""
    config = made.config
    return render.draw_list(made.beads, palette, cell, labels, round_), render.frame(made.beads.sparkSession, config.width, config.height, cell, labels, round_)


def used_palette(made: Pattern, palette: DataFrame) -> DataFrame:
    """The rows of a palette that an image uses, in the palette's order (ord)."""
    return made.beads.where("code is not null").select("image_id", "brand", "code").distinct().join(palette, ["brand", "code"])
