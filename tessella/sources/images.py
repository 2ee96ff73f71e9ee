"""Pixel relations: (image_id, seq, x, y, r, g, b, a, width, height), one row a pixel, seq = y * width + x."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.geometry import oriented
from tessella.shipping import ship


def _image_id(path: str) -> Column:
    """Of a file's path, which sources write with one or three slashes."""
    return F.xxhash64(F.regexp_replace(path, "^file:/+", "file:/"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files.  Spark's image source stores rows of BGR(A) or grey bytes."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    n = F.col("nChannels")
    at = F.col("seq") * n
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), (at + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    pixels = images.select("origin", "width", "height", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("seq"))
    blue, green, red = byte(0), F.when(n == 1, byte(0)).otherwise(byte(1)), F.when(n == 1, byte(0)).otherwise(byte(2))
    alpha = F.when(n == 4, byte(3)).otherwise(255)
    return pixels.select(_image_id("origin").alias("image_id"), F.col("seq").cast("long"), (F.col("seq") % F.col("width")).alias("x"), F.floor(F.col("seq") / F.col("width")).cast("int").alias("y"), red.alias("r"), green.alias("g"), blue.alias("b"), alpha.alias("a"), "width", "height")


def exif_orientation(content: bytes | None) -> int:
    """The orientation (1 to 8) that a JPEG or PNG file notes in its TIFF tags, 1 where it notes
    none or the tags are broken."""
    tags = b""
    if content is None:
        return 1
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:  # up to the image's data
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                tags = content[at + 10 : at + 2 + size]
                break
            at += 2 + size
    elif content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                tags = content[at + 8 : at + 8 + size]
                break
            at += 12 + size
    if tags[:2] not in (b"II", b"MM") or len(tags) < 8:
        return 1
    number = lambda at, n: int.from_bytes(tags[at : at + n], "little" if tags[:2] == b"II" else "big")
    first = number(4, 4)
    for at in range(first + 2, min(first + 2 + 12 * number(first, 2), len(tags) - 11), 12):
        if number(at, 2) == 0x0112 and number(at + 2, 2) == 3 and 1 <= number(at + 8, 2) <= 8:
            return number(at + 8, 2)
    return 1


def read_orientations(spark: SparkSession, path: str) -> DataFrame:
    """image_id and orientation of image files; image_id as ``read_images`` has it."""

    @F.pandas_udf("int")
    def noted(content: pd.Series) -> pd.Series:
        return content.map(exif_orientation)

    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))  # whole files: a batch ends by bytes
    files = spark.read.format("binaryFile").load(path)
    return files.select(_image_id("path").alias("image_id"), noted("content").alias("orientation"))


def read_upright(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files, turned as the files say."""
    pixels = read_images(spark, path)
    return oriented(pixels.join(read_orientations(spark, path), "image_id", "left"), F.col("orientation"))


def pixels_of_events(events: DataFrame, side: int = 50) -> DataFrame:
    """Synthetic images from an events table with dense ids: ``side`` x ``side`` pixels each, but
    for the last one, whose size follows from the largest id."""
    seq = F.col("event_id") % (side * side)
    last = F.broadcast(events.agg(F.max("event_id").alias("last")))  # one row
    events = events.crossJoin(last)
    there = F.least(F.lit(side * side), F.col("last") + 1 - F.expr(f"event_id div {side * side}") * (side * side))
    rows = events.select(F.expr(f"event_id div {side * side}").alias("image_id"), seq.alias("seq"), (seq % side).cast("int").alias("x"), F.floor(seq / side).cast("int").alias("y"), "user_id", "event_id", "value", "event_type", F.least(F.lit(side), there).cast("int").alias("width"), F.ceil(there / F.lit(side)).cast("int").alias("height"))
    tenth = lambda c: F.floor(F.col(c) / 10).cast("long")
    return rows.select(
        "image_id",
        "seq",
        "x",
        "y",
        ((tenth("x") * 51 + F.col("user_id") % 16) % 256).cast("int").alias("r"),
        ((tenth("y") * 51 + (F.col("event_id") % 7) * 3) % 256).cast("int").alias("g"),
        (F.floor("value").cast("int") % 256).alias("b"),
        F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 200).otherwise(255).alias("a"),
        "width",
        "height",
    )


def palette_of_parts(part: DataFrame) -> DataFrame:
    """Synthetic palettes from a part table: a colour a part, a palette a brand."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return part.select(
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0")).alias("code"),
        F.col("p_name").alias("name"),
        key.cast("int").alias("ord"),
        ((key * 97) % 256).cast("int").alias("r"),
        ((key * size * 11) % 256).cast("int").alias("g"),
        ((size * 29) % 256).cast("int").alias("b"),
    )
