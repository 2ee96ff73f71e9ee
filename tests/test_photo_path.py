"""The way of a photo to its cells: files, turns, resampling, colour, tiles, nearest colours."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators import geometry, matching, photo, pooling, resample, tiles
from tessella.plans import job, pattern, queries
from tessella.sources import images
from test_grid import image
from test_sources_jobs import png


def by_place(df, *columns):
    return {(r["x"], r["y"]): tuple(r[c] for c in columns or ("r", "g", "b", "a")) for r in df.collect()}


def tagged(path, width, height, at, orientation, order="<"):
    """A PNG whose eXIf chunk notes an orientation behind another tag."""
    png(path, width, height, at)
    raw = path.read_bytes()
    entry = lambda tag, value: struct.pack(order + "HHIHH", tag, 3, 1, value, 0)
    tags = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 2) + entry(0x0100, 9) + entry(0x0112, orientation) + bytes(4)
    chunk = struct.pack(">I", len(tags)) + b"eXIf" + tags + struct.pack(">I", zlib.crc32(b"eXIf" + tags))
    path.write_bytes(raw[:33] + chunk + raw[33:])


#: Where the upright pixel (x, y) of a w x h picture lies in a file of each orientation.
STORED = {
    1: lambda x, y, w, h: (x, y),
    2: lambda x, y, w, h: (w - 1 - x, y),
    3: lambda x, y, w, h: (w - 1 - x, h - 1 - y),
    4: lambda x, y, w, h: (x, h - 1 - y),
    5: lambda x, y, w, h: (y, x),
    6: lambda x, y, w, h: (y, w - 1 - x),
    7: lambda x, y, w, h: (h - 1 - y, w - 1 - x),
    8: lambda x, y, w, h: (h - 1 - y, x),
}


def test_eight_files_of_one_picture_are_one_relation(spark, tmp_path):
    w, h = 3, 2
    picture = {(x, y): (40 * x, 90 * y, 7, 255) for x in range(w) for y in range(h)}
    for o, place in STORED.items():
        stored = {place(x, y, w, h): v for (x, y), v in picture.items()}
        sides = (h, w) if o > 4 else (w, h)
        tagged(tmp_path / f"{o}.png", *sides, lambda x, y, own=stored: own[x, y], o, "<>"[o % 2])
    png(tmp_path / "plain.png", w, h, lambda x, y: picture[x, y])
    found = images.read_upright(spark, str(tmp_path))
    by_image = {}
    for r in found.collect():
        by_image.setdefault(r["image_id"], {})[r["x"], r["y"]] = (r["r"], r["g"], r["b"], r["a"])
        assert (r["width"], r["height"]) == (w, h)
    assert len(by_image) == 9 and all(p == picture for p in by_image.values())


def test_orientation_tags():
    tags = b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    app1 = b"\xff\xe1" + (len(tags) + 8).to_bytes(2, "big") + b"Exif\0\0" + tags
    assert images.exif_orientation(b"\xff\xd8\xff\xe0\0\x04ab" + app1 + b"\xff\xda") == 6
    for broken in (None, b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\xff\xff", b"\xff\xd8" + app1[:20], b"\xff\xd8" + app1.replace(b"\0\x06", b"\0\x0b"), b"\xff\xd8\xff\xda" + app1, b"GIF89a" + app1, b"\x89PNG\r\n\x1a\n\xff\xff\xff\xffeXIf"):
        assert images.exif_orientation(broken) == 1


def resampled(picture, width, height):
    """Pixel by pixel: both kernels over each target's surroundings at once."""
    h, w, _ = picture.shape
    scale = max(width / w, height / h)

    def weights(side, n):
        virtual = max(1, math.floor(side * scale + 0.5))
        ratio, off = side / virtual, math.floor((n - virtual) / 2)
        stretch = max(1.0, ratio)
        table = np.zeros((n, side))
        for target in range(n):
            centre = (target - off + 0.5) * ratio - 0.5
            for tap in range(math.floor(centre - 3 * stretch), math.ceil(centre + 3 * stretch) + 1):
                t = (tap - centre) / stretch
                if abs(t) < 3:
                    table[target, min(side - 1, max(0, tap))] += np.sinc(t) * np.sinc(t / 3)
        return table / table.sum(1, keepdims=True)

    across, down = weights(w, width), weights(h, height)
    apply = lambda c: down @ c @ across.T
    alpha = apply(picture[..., 3])
    rgb = [np.where(np.round(alpha, 6) > 0, apply(picture[..., k] * picture[..., 3]) / np.where(alpha == 0, 1, alpha), 0) for k in range(3)]
    return np.stack([np.floor(np.clip(np.round(c, 6), 0, 255) + 0.5) for c in (*rgb, alpha)], -1).astype(int)


@pytest.mark.parametrize("w,h,width,height", [(9, 7, 4, 4), (5, 4, 11, 6), (6, 6, 6, 6), (1, 1, 3, 2), (40, 3, 7, 5), (2, 17, 5, 5)])
def test_lanczos_by_force(spark, w, h, width, height):
    rng = random.Random(w)
    cut_out = lambda x, y: 0 if (x + y) % 5 == 4 else 255 - 30 * (x % 3)
    picture = {(x, y): (rng.randrange(256), rng.randrange(256), 255 * (x % 2), cut_out(x, y)) for x in range(w) for y in range(h)}
    given = image(spark, w, h, lambda x, y: picture[x, y])
    expected = resampled(np.array([[picture[x, y] for x in range(w)] for y in range(h)], float), width, height)
    assert by_place(resample.resize_lanczos(given, width, height)) == {(x, y): tuple(expected[y, x]) for x in range(width) for y in range(height)}


def test_lanczos_keeps_even_colours_and_empty_tables(spark):
    even = image(spark, 13, 9, lambda x, y: (10, 200, 255, 255))
    assert set(by_place(resample.resize_lanczos(even, 5, 5)).values()) == {(10, 200, 255, 255)}
    clear = image(spark, 13, 9, lambda x, y: (10, 200, 255, 0))
    assert set(by_place(resample.resize_lanczos(clear, 5, 5)).values()) == {(0, 0, 0, 0)}
    assert resample.resize_lanczos(even.where("false"), 5, 5).count() == 0


def test_modulate(spark):
    given = image(spark, 16, 16, lambda x, y: (16 * x, 16 * y, 8 * (x + y), 200))
    before = by_place(given)
    near = lambda p, q: all(abs(a - b) <= 1 for a, b in zip(p, q, strict=True))
    assert all(near(v, before[k]) for k, v in by_place(photo.modulate(given)).items())
    assert all(near(v, before[k]) for k, v in by_place(photo.modulate(given, hue=360.0)).items())
    greyed = by_place(photo.modulate(given, saturation=0.0))
    assert all(max(v[:3]) - min(v[:3]) <= 1 and v[3] == 200 for v in greyed.values())
    assert set(by_place(photo.modulate(given, brightness=0.0, saturation=0.0)).values()) == {(0, 0, 0, 200)}
    white = photo.modulate(image(spark, 1, 1, lambda x, y: (250, 240, 230, 255)), 1.08, 1.22).first()
    assert max(white["r"], white["g"], white["b"]) == 255
    assert photo.modulate(given).columns == given.columns


def test_photo_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "cards").mkdir()
    tagged(tmp_path / "in" / "a.png", 12, 24, lambda x, y: (250, 3, 3, 255) if y < 12 else (3, 3, 250, 255), 6)
    (tmp_path / "cards" / "acme.json").write_text('[{"code": "R", "rgbHex": "#FF0000", "name": "Red"}, {"code": "B", "rgbHex": "#0000FF"}]')
    job.main(["--images", str(tmp_path / "in"), "--palettes", str(tmp_path / "cards"), "--out", str(tmp_path / "out"), "--brand", "acme", "--mode", "photo", "--size", "8", "--svg"])
    beads = {(r["cx"], r["cy"]): r["code"] for r in spark.read.parquet(str(tmp_path / "out" / "beads")).collect()}
    assert beads == {(x, y): "B" if x < 4 else "R" for x in range(8) for y in range(8)}  # turned clockwise
    report = spark.read.parquet(str(tmp_path / "out" / "counts")).orderBy("place").collect()
    assert [(r["place"], r["code"], r["n"]) for r in report] == [(1, "B", 32), (2, "R", 32)]
    assert spark.read.parquet(str(tmp_path / "out" / "svg")).first()["svg"].count("data-bead") == 64


@pytest.mark.parametrize("size", [1, 2, 5])
def test_tiles_smaller_than_the_image(spark, size):
    at = lambda x, y: ((x * 83 + y * 31) % 256, (x * 7 + y * 59) % 256, 255 * (x > 3), 255 - x)
    given = image(spark, 11, 7, at).where("not (x = 4 and y = 3)")
    assert by_place(photo.bilateral(given, 1.0, 30.0, tile=size)) == by_place(photo.bilateral(given, 1.0, 30.0))
    whole = image(spark, 11, 7, at)
    edges = by_place(photo.gradients(whole, tile=size), "magnitude")
    assert len(edges) == 9 * 5 and edges == by_place(photo.gradients(whole), "magnitude")


def exchanges(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("- Exchange") + plan.count("ReusedExchange")


def test_tiles_are_dealt_once(spark):
    given = image(spark, 60, 40, lambda x, y: (x, y, 0, 255)).withColumns({"width": F.lit(60), "height": F.lit(40)})
    assert exchanges(photo.bilateral(given, 1.0, 30.0)) == 1
    rows = tiles.with_tiles(given, 2, 20).count()
    assert rows == (60 + 2 * 4) * (40 + 4)  # two inner borders across, one down, two pixels on each side


def test_sizes_come_with_the_pixels(spark, sf_dir):
    """Neither cells nor edges look for sizes in the pixels again."""
    pixels = queries.pixels(spark, sf_dir)
    for df in (pooling.foreground_ratio(pixels, 7, 9), pooling.area_downsample(pixels, 7, 9), photo.gradients(pixels)):
        assert "max(x" not in df._jdf.queryExecution().executedPlan().toString()
    assert exchanges(pooling.area_downsample(pixels, 7, 9)) == 2  # one row for the last id, one by cell
    partial = queries.images.pixels_of_events(spark.range(2500 + 120).selectExpr("id as event_id", "1 as user_id", "2.0D as value", "'x' as event_type"))
    assert {tuple(r) for r in geometry.sizes(partial).collect()} == {(0, 50, 50), (1, 50, 3)}
    found = partial.groupBy("image_id").agg(F.max("x") + 1, F.max("y") + 1).collect()
    assert {tuple(r) for r in found} == {(0, 50, 50), (1, 50, 3)}


def test_owners_of_pixels_are_those_of_the_windows(spark):
    """Against floor(g s) <= at < floor((g + 1) s), in doubles, for all sides."""
    sides = range(1, 120)
    for n in (1, 3, 7, 49, 57, 90):
        rows = spark.createDataFrame([(side, at) for side in sides for at in range(side)], "side int, at int")
        for r in rows.select("side", "at", pooling._owner("at", "side", n).alias("g")).collect():
            s = r["side"] / n
            assert math.floor(r["g"] * s) <= r["at"] < math.floor((r["g"] + 1) * s) or r["g"] == n and math.floor(n * s) <= r["at"]


def test_pruned_nearest_is_nearest(spark, sf_dir):
    """Random colours and greys against random palettes, with colours that repeat and ties."""
    rng = random.Random(2)
    spot = lambda: (rng.randrange(256), rng.randrange(256), rng.randrange(256))
    own = [spot() for _ in range(600)] + [(k, k, k) for k in range(0, 256, 5)]
    rows = [("T", f"c{k}", k, *c) for k, c in enumerate(own + own[:50])]
    palette = spark.createDataFrame(rows, "brand string, code string, ord int, r int, g int, b int")
    asked = spark.createDataFrame([*{spot() for _ in range(300)}, (0, 0, 0), (255, 255, 255), own[0]], "r int, g int, b int").distinct()
    colors = color.with_lab(asked)
    assert {tuple(r) for r in matching.nearest_pruned(colors, palette).collect()} == {tuple(r) for r in matching.nearest(colors, palette).collect()}
    one = palette.where("ord = 7")
    assert {r["ord"] for r in matching.nearest_pruned(colors, one).collect()} == {7}
    assert matching.nearest_pruned(colors.where("false"), palette).count() == 0


def test_pruned_pairs_are_few(spark, sf_dir):
    colors = matching.distinct_colors(queries.cells(spark, sf_dir)).cache()
    side = matching._side(matching.with_palette_lab(queries.palette(spark, sf_dir))).cache()
    assert matching.candidates(colors, side).count() < 0.25 * colors.count() * side.count()


def test_the_lightness_bound_holds(spark):
    rng = random.Random(4)
    lab = lambda: (rng.uniform(0, 100), rng.uniform(-128, 128), rng.uniform(-128, 128))
    rows = spark.createDataFrame([(*lab(), *lab()) for _ in range(20_000)], "l double, a double, b double, p double, q double, s double")
    measured = color.with_delta_e(rows, ("l", "a", "b"), ("p", "q", "s"))
    assert measured.where(F.abs(F.col("l") - F.col("p")) > F.col("delta_e") * matching.LIGHTNESS_DIVISOR + 1e-9).count() == 0


def test_photo_pattern_uses_photo_cells(spark, sf_dir):
    pixels = queries.pixels(spark, sf_dir)
    made = pattern.make_photo_pattern(pixels, queries.brand_palette(spark, sf_dir), 9, 5)
    assert {tuple(r) for r in made.cells.collect()} == {tuple(r) for r in pattern.photo_cells(pixels, 9, 9).collect()}
    assert all(r["actual_colors"] <= 5 and r["total"] == 81 for r in made.summary.collect())
