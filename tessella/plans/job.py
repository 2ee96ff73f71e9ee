"""A job: image files and palette files to pattern tables.

    spark-submit tessella/plans/job.py --images DIR --palettes DIR --out DIR [--brand mard]
        [--mode pattern] [--size 80] [--colors 40] [--svg]

Mode ``photo`` makes every resampled pixel of a photo a bead.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessella.operators import geometry, quantise, render
from tessella.plans.config import PRESETS, config_for
from tessella.plans.pattern import make_pattern, make_photo_pattern
from tessella.sources import images, palettes


def positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("a positive whole number is needed")
    return n


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="images to palette-quantised patterns")
    parser.add_argument("--images", required=True)
    parser.add_argument("--palettes", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--brand", default="mard")
    parser.add_argument("--mode", choices=sorted([*PRESETS, "photo"]), default="pattern")
    parser.add_argument("--size", type=positive)
    parser.add_argument("--colors", type=positive)
    parser.add_argument("--svg", action="store_true")
    own = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("pattern").getOrCreate()
    cards = palettes.with_channels(palettes.read_json_cards(spark, own.palettes))
    palette = palettes.of_brand_or_first(cards, own.brand).cache()
    pixels = images.read_upright(spark, own.images)
    if own.mode == "photo":
        made = make_photo_pattern(pixels, palette, own.size or 96, own.colors or 32)
    else:
        changes = {k: v for k, v in (("width", own.size), ("height", own.size), ("max_colors", own.colors)) if v}
        made = make_pattern(geometry.bound_size(pixels), palette, config_for(own.mode, own.brand, **changes))
    made.beads.write.mode("overwrite").parquet(f"{own.out}/beads")
    beads = spark.read.parquet(f"{own.out}/beads")
    render.count_report(quantise.counts(beads, first=True), palette).write.mode("overwrite").parquet(f"{own.out}/counts")
    if own.svg:
        render.svg_documents(beads, palette, made.config.width, made.config.height, 12).write.mode("overwrite").parquet(f"{own.out}/svg")


if __name__ == "__main__":
    main()
