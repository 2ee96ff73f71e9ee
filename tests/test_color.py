import pytest
from pyspark.sql import functions as F

from tessella.functions import color, strings

#: Published CIEDE2000 pairs and their differences.
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, 2.8361, -74.0200, 50.0, 0.0, -82.7485, 3.4412),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, -1.1848, -84.8006, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, -0.9009, -85.5211, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669),
    (50.0, 2.4900, -0.0010, 50.0, -2.4900, 0.0009, 7.1792),
    (50.0, 2.4900, -0.0010, 50.0, -2.4900, 0.0011, 7.2195),
    (50.0, -0.0010, 2.4900, 50.0, 0.0009, -2.4900, 4.8045),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (50.0, 2.5, 0.0, 61.0, -5.0, 29.0, 22.8977),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (63.0109, -31.0961, -5.8663, 62.8187, -29.7946, -4.0864, 1.2630),
    (22.7233, 20.0904, -46.6940, 23.0331, 14.9730, -42.5619, 2.0373),
    (90.8027, -2.0831, 1.4410, 91.1528, -1.6435, 0.0447, 1.4441),
    (6.7747, -0.2908, -2.4247, 5.8714, -0.0985, -2.2286, 0.6377),
    (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_delta_e_of_published_pairs(spark):
    df = spark.createDataFrame(PAIRS, "lab_l double, lab_a double, lab_b double, p_l double, p_a double, p_b double, expected double")
    rows = color.with_delta_e(df, ("lab_l", "lab_a", "lab_b"), ("p_l", "p_a", "p_b")).collect()
    assert all(abs(r["delta_e"] - r["expected"]) < 5e-4 for r in rows)


def test_delta_e_of_numpy_agrees():
    from tessella.operators.quantise import delta_e

    for *pair, expected in PAIRS:
        assert abs(float(delta_e(pair[:3], [pair[3:]])[0]) - expected) < 5e-4


def test_lab_and_back(spark):
    df = spark.createDataFrame([(255, 255, 255), (255, 0, 0), (123, 200, 45), (0, 0, 0)], "r int, g int, b int")
    lab = color.with_lab(df)
    white, red = lab.collect()[:2]
    assert white["lab_l"] == pytest.approx(100, abs=0.01) and abs(white["lab_a"]) < 0.05
    assert (red["lab_l"], red["lab_a"], red["lab_b"]) == pytest.approx((53.24, 80.09, 67.20), abs=0.05)
    back = color.with_rgb(lab.withColumnsRenamed({"r": "r0", "g": "g0", "b": "b0"}))
    assert all(abs(x["r"] - x["r0"]) <= 1 and abs(x["g"] - x["g0"]) <= 1 and abs(x["b"] - x["b0"]) <= 1 for x in back.collect())


def test_hex(spark):
    df = spark.createDataFrame([("#ff0000",), ("00ff00",), ("#0000FF",)], "h string")
    r, g, b = color.hex_to_rgb(F.col("h"))
    assert [tuple(x) for x in df.select(r, g, b).collect()] == [(255, 0, 0), (0, 255, 0), (0, 0, 255)]
    out = spark.createDataFrame([(300.0, -4.0, 15.5)], "r double, g double, b double").select(color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("h"))
    assert out.first()["h"] == "#ff0010"
    bad = spark.createDataFrame([("#12345g",)], "h string").select(*color.hex_to_rgb_strict(F.col("h")))
    with pytest.raises(Exception, match="not a colour"):
        bad.collect()


def test_sizes_and_ratios(spark):
    df = spark.createDataFrame([(" 1920X1080 ",), ("9x9",), (None,), ("4000x4000",)], "s string")
    w, h = strings.parse_size(F.col("s"))
    rows = df.select(w.alias("w"), h.alias("h")).select("*", strings.nearest_ratio(F.col("w"), F.col("h")).alias("ratio"), strings.resolution(F.col("w"), F.col("h")).alias("res")).collect()
    assert [tuple(r) for r in rows] == [(1920, 1080, "16:9", "2k"), (None, None, "1:1", "2k"), (None, None, "1:1", "2k"), (4000, 4000, "1:1", "4k")]


def test_small_strings(spark):
    df = spark.createDataFrame([("1e3", "data:image/png;base64,QUJD")], "n string, u string")
    row = df.select(strings.as_number(F.col("n")).alias("n"), strings.as_number(F.lit("x")).alias("bad"), strings.data_url_bytes(F.col("u")).alias("b"), strings.crc32_hex(F.lit("abc")).alias("c")).first()
    assert (row["n"], row["bad"], bytes(row["b"]), row["c"]) == (1000.0, None, b"ABC", "352441c2")
