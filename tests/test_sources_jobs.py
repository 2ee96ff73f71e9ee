import hmac
import json
import math
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import strings
from tessella.operators import clustering, photo, quantise
from tessella.plans import job
from tessella.sources import images
from test_grid import BLUE, RED, codes, grid, image, palette  # noqa: F401


def png(path, width, height, at):
    """at(x, y) -> (r, g, b, a)"""
    raw = b"".join(b"\0" + b"".join(bytes(at(x, y)) for x in range(width)) for y in range(height))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_image_files(spark, tmp_path):
    png(tmp_path / "a.png", 3, 2, lambda x, y: (10 * x, 20 * y, 200, 255 if x else 7))
    rows = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"], r["seq"]) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert rows == {(x, y): (10 * x, 20 * y, 200, 255 if x else 7, y * 3 + x) for x in range(3) for y in range(2)}


def test_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "cards").mkdir()
    png(tmp_path / "in" / "a.png", 12, 12, lambda x, y: (250, 3, 3, 255) if x < 6 else (3, 3, 250, 255))
    (tmp_path / "cards" / "acme.json").write_text(json.dumps([{"code": "R", "rgbHex": "#FF0000", "name": "Red"}, {"code": "B", "rgbHex": "#0000FF"}]))
    job.main(["--images", str(tmp_path / "in"), "--palettes", str(tmp_path / "cards"), "--out", str(tmp_path / "out"), "--brand", "none", "--size", "6", "--colors", "4", "--svg"])
    counts = {(r["code"], r["name"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out" / "counts")).collect()}
    assert counts == {("R", "Red"): 18, ("B", ""): 18}
    assert spark.read.parquet(str(tmp_path / "out" / "svg")).first()["svg"].count("data-bead") == 36
    with pytest.raises(SystemExit):
        job.main(["--images", "x", "--palettes", "y", "--out", "z", "--size", "0"])


def test_clusters(spark, palette):  # noqa: F811
    near_red = (240, 10, 12)
    cells = grid(spark, [[RED, near_red, BLUE], [RED, BLUE, None]])
    for options in ({}, {"snap": True}, {"dither": 0.2}):
        out = codes(clustering.cluster_quantise(cells, palette, 3, **options))
        assert out == [["R", "R", "B"], ["R", "B", None]]
    one = clustering.cluster_quantise(cells, palette, 1)
    assert len({c for row in codes(one) for c in row if c}) == 1 and quantise.summary(one).first()["total"] == 5
    assert {r["n"] for r in clustering.cluster_palettes(cells, palette, 3).collect()} <= {1, 2, 3}


def test_tone(spark):
    row = photo.tone(image(spark, 1, 1, lambda x, y: (250, 100, 0, 255)), (1.06, 1.02, 0.94), (10, 6, 0)).first()
    assert (row["r"], row["g"], row["b"]) == (255, 108, 0)


def test_proxy_strings(spark):
    df = spark.createDataFrame([("https://a", "WEBP", '{"data":[{"error":{"message":" no "}}]}', {"a b": "c&d"})], "u string, f string, e string, m map<string,string>")
    row = df.select(strings.is_image_input(F.col("u")), strings.image_format(F.col("f")), strings.error_message(F.col("e")), strings.query_string(F.col("m")), strings.dimensions(F.lit("4k"), F.lit("16:9")), strings.to_hex(F.lit(b"\x0f"))).first()
    assert tuple(row) == (True, "webp", "no", "a+b=c%26d", "5404x3040", "0f")


def test_keyed_digests(spark):
    cases = [("", ""), ("key", "The quick brown fox jumps over the lazy dog"), ("k" * 64, "m"), ("ü" * 40, "long key"), ("k" * 65, "")]
    rows = spark.createDataFrame(cases, "k string, m string").select("k", "m", strings.hmac_sha256_hex(F.col("k"), F.col("m")).alias("mac")).collect()
    assert [r["mac"] for r in rows] == [hmac.new(k.encode(), m.encode(), "sha256").hexdigest() for k, m in cases]


def test_random_ids(spark):
    rows = spark.range(200).select(strings.uuid().alias("u"), strings.uuid(False).alias("h"), strings.random_large_id().alias("n")).collect()
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", r["u"]) and re.fullmatch("[0-9a-f]{32}", r["h"]) for r in rows)
    assert len({r["u"] for r in rows}) == 200 and all(7 * 10**18 <= int(r["n"]) < 8 * 10**18 for r in rows)


def test_smoothing_by_force(spark):
    """The definition, pixel by pixel, on an image that lacks one."""
    at = lambda x, y: ((x * 83 + y * 31) % 256, (x * 7 + y * 59) % 256, 255 * (x > 3), 255)
    given = image(spark, 7, 5, at).where("not (x = 2 and y = 1)")
    there = {(x, y): at(x, y)[:3] for x in range(7) for y in range(5) if (x, y) != (2, 1)}
    wanted = {}
    for (x, y), own in there.items():
        sums, total = [0.0] * 3, 0.0
        for dx in range(-2, 3):
            for dy in range(-2, 3):
                near = there.get((min(6, max(0, x + dx)), min(4, max(0, y + dy))))
                if near:
                    w = math.exp(-(dx * dx + dy * dy) / 2) * math.exp(-sum((p - q) ** 2 for p, q in zip(own, near, strict=True)) / 1800)
                    sums, total = [s + w * c for s, c in zip(sums, near, strict=True)], total + w
        wanted[x, y] = tuple(math.floor(s / total + 0.5) for s in sums)
    smoothed = photo.bilateral(given, 1.0, 30.0)
    assert {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in smoothed.collect()} == wanted
    assert photo.bilateral(given.where("false"), 1.0, 30.0).count() == 0
