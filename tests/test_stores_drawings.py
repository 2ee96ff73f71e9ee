"""Stored palettes and what is drawn or laid out from patterns."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import assembly, geometry, pooling, raster, render
from tessella.plans import queries
from tessella.sources import palettes
from test_grid import bead_grid, palette  # noqa: F401

CARD = "brand string, code string, name string, ord int"


def files_of(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_an_upserted_table_changes_only_brands_that_differ(spark, tmp_path):
    path = tmp_path / "cards"
    first = spark.createDataFrame([("a", "1", "one", 0), ("a", "2", None, 1), ("b", "1", "x", 2), ("c", "9", "y", 3)], CARD)
    stored = palettes.upsert_table(spark, str(path), first)
    assert rows_of(stored, "brand", "code", "version") == [("a", "1", 1), ("a", "2", 1), ("b", "1", 1), ("c", "9", 1)]
    before = files_of(path)
    new = spark.createDataFrame([("a", "2", "two", 7), ("a", "2", "three", 8), ("b", "1", "x", 9), ("d", "5", None, 10)], CARD)
    stored = palettes.upsert_table(spark, str(path), new)
    expected = [("a", "1", "one", 0, 2), ("a", "2", "three", 8, 2), ("b", "1", "x", 2, 1), ("c", "9", "y", 3, 1), ("d", "5", None, 10, 2)]
    assert rows_of(stored, "brand", "code", "name", "ord", "version") == expected
    after = files_of(path)
    kept = lambda files: {k: v for k, v in files.items() if k.parts[0] in ("brand=b", "brand=c")}
    assert kept(before) == kept(after) and set(before) - set(after)
    assert rows_of(palettes.upsert_table(spark, str(path), new), "brand", "code", "name", "ord", "version") == expected
    assert files_of(path) == after  # the same upsert again writes nothing


def test_an_upsert_that_broke_off_is_run_again(spark, tmp_path):
    """As if only brand a had been replaced when the run ended."""
    path = str(tmp_path / "cards")
    old = spark.createDataFrame([("a", "1", "old", 0), ("b", "1", "old", 1)], CARD)
    new = spark.createDataFrame([("a", "1", "new", 0), ("b", "1", "new", 1)], CARD)
    palettes.upsert_table(spark, path, old)
    palettes.upsert_table(spark, path, new.where("brand = 'a'"))
    assert rows_of(palettes.upsert_table(spark, path, new), "brand", "name", "version") == [("a", "new", 2), ("b", "new", 3)]
    nothing = spark.createDataFrame([], CARD)
    assert palettes.upsert_table(spark, path, nothing).count() == 2
    assert palettes.upsert_table(spark, str(tmp_path / "none"), nothing).count() == 0


def whole(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_a_json_array_over_many_files(spark, tmp_path):
    rows = [(k, f'na"me\n{k}, ]', None if k % 3 else "é") for k in range(200)]
    table = spark.createDataFrame(rows, "id int, name string, source string").repartition(5, "name")
    palettes.write_json_array(table, str(tmp_path / "many"), parts=7)
    assert len(list((tmp_path / "many").glob("part-*"))) == 7
    assert whole(tmp_path / "many") == [{"id": i, "name": n, "source": s} for i, n, s in rows]
    back = palettes.read_json_array(spark, str(tmp_path / "many"), "id int, name string, source string")
    assert rows_of(back) == sorted(rows, key=lambda r: r[0])
    for n, name in ((0, "none"), (1, "one")):
        palettes.write_json_array(table.where(f"id < {n}"), str(tmp_path / name))
        assert len(whole(tmp_path / name)) == n
        assert palettes.read_json_array(spark, str(tmp_path / name), "id int").count() == n


def test_brand_files_and_back(spark, tmp_path):
    rows = [("acme", "A2", 'x"y', "#FF0000", None, True, 0), ("acme", "A1", None, "#0000FF", "s", False, 1), ("b c", "Z", "z", "#00FF00", "s", False, 0)]
    cards = spark.createDataFrame(rows, "brand string, code string, name string, rgbHex string, source string, isApproximate boolean, ord int")
    palettes.write_brand_files(cards, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("*.json")) == ["acme.json", "b c.json"]
    assert [c["code"] for c in json.loads((tmp_path / "out" / "acme.json").read_text())] == ["A2", "A1"]
    back = palettes.read_json_cards(spark, str(tmp_path / "out")).where("brand = 'acme'")
    assert rows_of(back, "code", "name", "ord") == [("A1", None, 1), ("A2", 'x"y', 0)]


def drawn(df):
    return {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in df.collect()}


def test_raster_of_squares(spark, palette):  # noqa: F811
    beads = bead_grid(spark, [["R", None], ["B", "unknown"]])
    plain = drawn(raster.raster(beads, palette, 2, 2, 3, grid=False))
    assert len(plain) == 8 * 8 and plain[0, 0] == (255, 0, 0) and plain[2, 5] == (0, 0, 255)
    assert plain[3, 0] == plain[5, 5] == (249, 250, 251) and plain[6, 1] == plain[7, 7] == (255, 255, 255)
    lined = drawn(raster.raster(beads, palette, 2, 2, 3))
    half = tuple(math.floor((a + b) / 2 + 0.5) for a, b in zip((255, 0, 0), (156, 163, 175), strict=True))
    assert lined[1, 1] == (255, 0, 0) and lined[0, 1] == lined[1, 0] == lined[2, 1] == half
    assert lined[6, 1] == tuple(math.floor((255 + c) / 2 + 0.5) for c in (156, 163, 175)) and lined[7, 1] == (255, 255, 255)
    room = drawn(raster.raster(beads, palette, 2, 2, 3, labels=True))
    assert len(room) == 26 * 26 and room[0, 0] == (255, 255, 255) and room[19, 19] == (255, 0, 0)
    thick = drawn(raster.raster(beads, palette, 2, 2, 40))
    assert thick[0, 5] == (156, 163, 175) and thick[1, 5] == (255, 0, 0) and thick[39, 5] == thick[40, 5] == (156, 163, 175)


def test_raster_of_round_beads(spark, palette):  # noqa: F811
    cell = 22
    out = drawn(raster.raster(bead_grid(spark, [["R", None]]), palette, 2, 1, cell, round_=True))
    radius, middle = 10, 11
    assert len(out) == 46 * 24 and out[0, 0] == (255, 255, 255) and out[30, 10] == (249, 250, 251)
    assert out[middle, middle] == (255, 0, 0)  # the gradient's even part
    spot = out[int(middle - 0.25 * radius), int(middle - 0.28 * radius)]
    assert spot[0] == 255 and spot[1] > 60  # the lighter spot under the highlight
    edge = out[middle + 8, middle]
    assert edge[0] < 255 and edge[1:] == (0, 0)  # darker towards the rim
    assert out[19, 16] == (230, 230, 230)  # only the shadow reaches here
    small = drawn(raster.raster(bead_grid(spark, [["R"]]), palette, 1, 1, 2, round_=True))
    assert set(small.values()) == {(255, 255, 255)}  # too small for a bead


def test_a_drawing_is_an_image_again(spark, sf_dir):
    """Pooled to cells of its own, a drawing gives the colours of the beads back."""
    beads, palette_ = queries.beads(spark, sf_dir).cache(), queries.palette(spark, sf_dir)
    image = raster.raster(beads, palette_, 10, 10, 6, grid=False).where("x < 60 and y < 60").withColumns({"width": F.lit(60), "height": F.lit(60)})
    cells = pooling.mode_downsample(image, 10, 10, 0.5, 0xFF)
    wanted = beads.join(palette_.select("brand", "code", "r", "g", "b"), ["brand", "code"]).select("image_id", "cx", "cy", "r", "g", "b")
    assert rows_of(cells.join(wanted.select("image_id", "cx", "cy"), ["image_id", "cx", "cy"], "left_semi")) == rows_of(wanted)


def pages_by_force(width, height, n):
    """Row after row at a running height."""
    page_w, page_h = (297.0, 210.0) if width > height else (210.0, 297.0)
    row, margin = 20.35 * 25.4 / 72, 40 * 25.4 / 72
    y, page, out, head = 41.0 + height * min((page_w - 30) / width, page_h * 0.55 / height), 1, [], False
    for place in range(1, n + 1):
        if not head and y + 2 * row > page_h - margin + 1e-9 or head and y + row > page_h - margin + 1e-9:
            page, y, head = page + 1, margin, False
        if not head:
            out.append((page, round(y, 6), "head", None))
            y, head = y + row, True
        out.append((page, round(y, 6), "row", place))
        y += row
    return out


@pytest.mark.parametrize("width,height", [(100, 100), (300, 100), (100, 400), (1, 1)])
@pytest.mark.parametrize("n", [1, 9, 200])
def test_report_pages(spark, width, height, n):
    report = spark.range(1, n + 1).selectExpr("7L as image_id", "cast(id as int) as place", "'T' as brand", "'c' as code", "'' as name", "id as n")
    sizes = spark.createDataFrame([(7, width, height), (8, 5, 5)], "image_id long, width int, height int")
    got = [(r["page"], round(r["y"], 6), r["kind"], r["place"]) for r in render.report_pages(report, sizes).orderBy("page", "y").collect()]
    assert got == pages_by_force(width, height, n)


@pytest.mark.parametrize("options", [{}, {"labels": True}, {"labels": True, "round_": True}, {"round_": True}])
def test_frames_of_many_grids(spark, options):
    grids = spark.createDataFrame([(1, 3, 2), (2, 1, 4)], "image_id long, width int, height int")
    found = render.frames(grids, 30, **options)
    columns = ["kind", "text", "x1", "y1", "x2", "y2", "size", "color_hex"]
    key = lambda r: tuple(map(str, r))
    for image_id, w, h in ((1, 3, 2), (2, 1, 4)):
        got = sorted((tuple(r) for r in found.where(F.col("image_id") == image_id).select(*columns).collect()), key=key)
        assert got == sorted((tuple(r) for r in render.frame(spark, w, h, 30, **options).select(*columns).collect()), key=key)


def test_boards_cells_and_progress(spark):
    grids = spark.createDataFrame([(1, 5, 4), (2, 1, 1), (3, 0, 4)], "image_id long, width int, height int")
    boards = geometry.boards_of(grids, F.lit(2)).orderBy("image_id", "board_index").collect()
    assert [r["image_id"] for r in boards] == [1] * 6 + [2] and (boards[2]["width"], boards[5]["y"]) == (1, 2)
    assert geometry.boards_of(grids.limit(1), F.lit(0)).count() == 20
    given = [(800, 20, 1, 3), (100, 50, 0, 0), (100, 1, 1, 2), (2000, 80, 2, 3)]
    rows = spark.createDataFrame(given, "c int, n int, d int, t int").select(geometry.cell_size(F.col("c"), F.col("n")), geometry.progress(F.col("d"), F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(30, 33), (12, 0), (30, 50), (24, 67)]


def test_ranks_collate_mixed_case(spark):
    keys = ["b:1", "A:2", "a:10", "B:2", "a:2", "é:1", "f:1", "E:1"]
    stats = spark.createDataFrame([(1, k, 5, 5) for k in keys], "image_id int, color_key string, total int, board_count int")
    assert [r["color_key"] for r in assembly.ranked(stats).orderBy("by_total").collect()] == ["a:10", "a:2", "A:2", "b:1", "B:2", "E:1", "é:1", "f:1"]
