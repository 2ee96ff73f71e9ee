import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import assembly, cleanup, clustering, geometry, matching, photo, pooling, quantise, render, replacement
from tessella.plans import pattern, queries
from tessella.plans.config import Config, config_for
from tessella.sources import palettes

PALETTE = [("TEST", "R", 0, 255, 0, 0), ("TEST", "B", 1, 0, 0, 255), ("TEST", "G", 2, 0, 255, 0), ("TEST", "W", 3, 255, 255, 255), ("TEST", "K", 4, 0, 0, 0)]
RED, BLUE, GREEN = (255, 0, 0), (0, 0, 255), (0, 255, 0)


@pytest.fixture(scope="module")
def palette(spark):
    return spark.createDataFrame(PALETTE, "brand string, code string, ord int, r int, g int, b int").withColumn("name", F.col("code"))


def image(spark, width, height, at):
    """at(x, y) -> (r, g, b, a)"""
    rows = [(1, y * width + x, x, y, *at(x, y)) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "image_id long, seq long, x int, y int, r int, g int, b int, a int")


def grid(spark, rows):
    out = [(1, x, y, *(c or (None, None, None))) for y, row in enumerate(rows) for x, c in enumerate(row)]
    return spark.createDataFrame(out, "image_id long, cx int, cy int, r int, g int, b int")


def bead_grid(spark, rows):
    out = [(1, x, y, "TEST" if c else None, c) for y, row in enumerate(rows) for x, c in enumerate(row)]
    return spark.createDataFrame(out, "image_id long, cx int, cy int, brand string, code string")


def codes(df):
    rows = df.select("cx", "cy", "code").collect()
    out = [[None] * (max(r["cx"] for r in rows) + 1) for _ in range(max(r["cy"] for r in rows) + 1)]
    for r in rows:
        out[r["cy"]][r["cx"]] = r["code"]
    return out


def test_mode_pooling_masks_and_thresholds(spark):
    halves = image(spark, 4, 4, lambda x, y: (255, 0, 0, 255) if x < 2 else (0, 0, 255, 255))
    rows = {(r["cx"], r["cy"]): (r["r"], r["g"], r["b"]) for r in pooling.mode_downsample(halves, 2, 2).collect()}
    assert rows[0, 0] == (248, 0, 0) and rows[1, 1] == (0, 0, 248)
    one = image(spark, 2, 2, lambda x, y: (255, 0, 0, 255 if (x, y) == (0, 0) else 0))
    for threshold, expected in ((0.4, None), (0.5, None), (0.1, 248), (0.0, 248)):
        assert pooling.mode_downsample(one, 1, 1, threshold).first()["r"] == expected
    none = image(spark, 2, 2, lambda x, y: (9, 9, 9, 0))
    assert pooling.mode_downsample(none, 1, 1, 0.0).first()["r"] is None


def test_mode_pooling_of_a_grid_larger_than_the_image(spark):
    rows = pooling.mode_downsample(image(spark, 2, 2, lambda x, y: (255, 0, 0, 255)), 3, 3, 0.0).collect()
    assert len(rows) == 9 and sum(r["r"] is not None for r in rows) == 4


def test_mean_pooling(spark):
    solid = image(spark, 50, 30, lambda x, y: (128, 64, 192, 100))
    rows = pooling.area_downsample(solid, 5, 3).collect()
    assert len(rows) == 15 and {(r["r"], r["g"], r["b"]) for r in rows} == {(128, 64, 192)}
    assert {r["a"] for r in pooling.alpha_downsample(solid, 5, 3).collect()} == {100}


def test_posterize_and_edges(spark):
    out = photo.posterize(image(spark, 1, 1, lambda x, y: (120, 140, 250, 200)), 4).first()
    assert (out["r"], out["g"], out["b"], out["a"]) == (85, 170, 255, 200)
    step = image(spark, 5, 5, lambda x, y: (20, 20, 20, 255) if x < 2 else (240, 240, 240, 255))
    edged = {(r["x"], r["y"]): r for r in photo.enhance_edges(step, 20, 0.5).collect()}
    assert edged[2, 2]["r"] == 120 and edged[2, 2]["a"] == 255 and edged[0, 0]["r"] == 20


def test_flood_fill_and_its_guard(spark):
    spot = image(spark, 5, 5, lambda x, y: (200, 80, 20, 255) if (x, y) == (2, 2) else (250, 250, 250, 255))
    out = {(r["x"], r["y"]): r["a"] for r in photo.flood_fill_background(spot, 8).collect()}
    assert out[0, 0] == 0 and out[2, 2] == 255
    solid = image(spark, 4, 4, lambda x, y: (9, 9, 9, 255))
    assert {r["a"] for r in photo.flood_fill_background(solid, 8).collect()} == {255}


def test_subject_fill(spark):
    spot = image(spark, 8, 8, lambda x, y: (10, 20, 30, 255) if x in (3, 4) and y in (3, 4) else (0, 0, 0, 0))
    rows = geometry.subject_fill(spot, 10, 0.1).collect()
    assert len(rows) == 100 and sum(r["a"] == 255 for r in rows) == 64
    assert next(r["a"] for r in rows if (r["x"], r["y"]) == (0, 0)) == 0


def test_bound_size(spark):
    small = geometry.bound_size(image(spark, 40, 10, lambda x, y: (x, y, 0, 255)), 20)
    assert tuple(geometry.sizes(small).first()) == (1, 20, 5)


def test_quantise_exact_and_nulls(spark, palette):
    exact = quantise.quantise(grid(spark, [[RED, BLUE], [BLUE, RED]]), palette, 5)
    assert codes(exact) == [["R", "B"], ["B", "R"]]
    holes = quantise.quantise(grid(spark, [[RED, None], [None, BLUE]]), palette, 5)
    assert codes(holes) == [["R", None], [None, "B"]]
    assert tuple(quantise.summary(holes).first())[:3] == (1, 2, 2)


def test_reduction_keeps_the_most_frequent_first_seen_of_equals(spark, palette):
    small = palette.where("code in ('R', 'B', 'G')")
    cells = grid(spark, [[RED, RED, RED], [RED, BLUE, GREEN]])
    counts = {r["code"]: r["n"] for r in quantise.counts(quantise.quantise(cells, small, 2)).collect()}
    assert counts == {"R": 4, "B": 2}


def test_nothing_dropped_keeps_palette_order_for_ties(spark):
    twins = spark.createDataFrame([("T", "second", 1, 255, 235, 250, None), ("T", "first", 0, 255, 235, 250, None)], "brand string, code string, ord int, r int, g int, b int, name string")
    assert codes(quantise.quantise(grid(spark, [[(255, 235, 250)]]), twins, 5)) == [["first"]]


def test_confetti(spark, palette):
    out = quantise.quantise(grid(spark, [[RED, RED], [RED, BLUE]]), palette, 5, confetti_ratio=0.3)
    assert codes(out) == [["R", "R"], ["R", "R"]]


def test_dither_keeps_holes_and_palette(spark, palette):
    small = palette.where("code in ('R', 'B')")
    out = codes(quantise.quantise(grid(spark, [[RED, None], [BLUE, (120, 0, 130)]]), small, 5, dither=1.0))
    assert out[0][1] is None and {c for row in out for c in row if c} <= {"R", "B"}
    assert sum(c is not None for row in out for c in row) == 3


def test_isolated_points(spark):
    rows = [["R", "R", "R"], ["R", "B", "R"], ["R", "R", "R"]]
    assert codes(cleanup.clean_isolated(bead_grid(spark, rows), 1))[1][1] == "R"
    assert codes(cleanup.clean_isolated_at_once(bead_grid(spark, rows)))[1][1] == "R"
    block = [["R", "R", "R", "R"], ["R", "B", "B", "R"], ["R", "B", "B", "R"], ["R", "R", "R", None]]
    assert codes(cleanup.clean_isolated(bead_grid(spark, block))) == block
    assert codes(cleanup.clean_isolated_at_once(bead_grid(spark, block))) == block


def test_replacement_is_single_pass(spark):
    swaps = spark.createDataFrame([("TEST:R", "TEST", "B"), ("TEST:B", "TEST", "R")], "color_key string, brand string, code string")
    assert codes(replacement.replace_colors(bead_grid(spark, [["R", "B", "R", None]]), swaps)) == [["B", "R", "B", None]]
    empty = swaps.limit(0)
    assert codes(replacement.replace_colors(bead_grid(spark, [["R", None]]), empty)) == [["R", None]]


def test_boards(spark, palette):
    boards = geometry.board_regions(spark, 5, 4, 2).orderBy("board_index").collect()
    assert len(boards) == 6 and boards[2]["width"] == 1 and boards[5]["y"] == 2
    beads = bead_grid(spark, [["R", "B", "R"], ["B", "R", "B"], ["R", "B", "R"]])
    stats = assembly.ranked(assembly.color_stats(beads, palette, 2, board=0)).orderBy("by_total").collect()
    assert [(r["code"], r["total"], r["board_count"]) for r in stats] == [("R", 5, 2), ("B", 4, 2)]
    assert {r["beads"] for r in assembly.board_totals(beads, 2).collect()} == {4, 2, 1}


def test_palette_files(spark, tmp_path):
    (tmp_path / "acme.json").write_text(json.dumps([{"code": "A2", "name": "Red", "rgbHex": "#FF0000", "isApproximate": True}, {"code": "A1", "name": "Blue", "rgbHex": "#0000FF"}]))
    (tmp_path / "zeta.json").write_text(json.dumps([{"code": "Z1", "rgbHex": "#00FF00"}]))
    cards = palettes.numbered(palettes.read_json_cards(spark, str(tmp_path)))
    rows = cards.orderBy("id").collect()
    assert [(r["brand"], r["code"], r["ord"], r["id"], r["isApproximate"], r["name"]) for r in rows] == [("acme", "A2", 0, 1, True, "Red"), ("acme", "A1", 1, 2, False, "Blue"), ("zeta", "Z1", 0, 3, False, None)]
    assert [r["code"] for r in palettes.of_brand(cards, "acme").collect()] == ["A1", "A2"]
    assert palettes.of_brand(cards, "none").count() == 0
    with pytest.raises(ValueError):
        palettes.of_brand(cards, None)
    assert {r["code"] for r in palettes.of_brand_or_first(cards.where("brand = 'acme'"), "none").collect()} == {"A1", "A2"}
    assert palettes.with_channels(cards).where("code = 'A2'").first()["lab_l"] == pytest.approx(53.24, abs=0.05)
    palettes.write_json(cards, str(tmp_path / "out"), by_brand=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    (tmp_path / "b.csv").write_text("C1,Red,255,0,0\nC2,Sea,0,18,171\n")
    assert [r["rgbHex"] for r in palettes.read_csv_cards(spark, str(tmp_path / "b.csv"), "src", "beta").collect()] == ["#FF0000", "#0012AB"]


def test_whole_plan(spark, palette):
    red = image(spark, 40, 40, lambda x, y: (250, 5, 5, 255))
    made = pattern.make_pattern(red, palette, Config(7, 7, max_colors=2))
    assert made.beads.count() == 49 and [tuple(r) for r in made.counts.collect()] == [(1, "TEST", "R", 49)]
    patch = image(spark, 8, 8, lambda x, y: (0, 0, 255, 255) if x < 2 and y < 2 else (255, 0, 0, 255))
    counts = {r["code"]: r["n"] for r in pattern.make_pattern(patch, palette, Config(8, 8)).counts.collect()}
    assert counts == {"R": 60, "B": 4}


def test_config():
    assert config_for("subject").edge_darken == 0.7 and config_for("logo").mask == 0xF8
    assert Config(5, 5, posterize_levels=3, pattern_mode="subject").resolved().posterize_levels == 3
    with pytest.raises(ValueError):
        Config(5, 5, pattern_mode="other")


def test_svg(spark, palette):
    svg = render.svg_documents(bead_grid(spark, [["R", "B"], [None, "R"]]), palette, 2, 2, 10).first()["svg"]
    assert svg.count("data-bead") == 3 and svg.count("<circle") == 9 and svg.count("<radialGradient") == 2 and svg.index("bead-TEST-R") < svg.index("bead-TEST-B")
    assert svg.startswith("<svg ") and svg.endswith("</svg>")


def test_driver_contract(spark, sf_dir):
    import __spark_entry__ as entry

    assert {"bead_counts", "dither", "photo_to_pattern"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


class Seen(Exception):
    pass


def test_queries_take_all_iterations_and_pixels(spark, sf_dir, monkeypatch):
    asked = []

    def kmeans(cells, k, max_iterations=30):
        asked.append(max_iterations)
        raise Seen

    def bounds(pixels):
        asked.append(pixels.count())
        raise Seen

    monkeypatch.setattr(clustering, "kmeans", kmeans)
    monkeypatch.setattr(geometry, "foreground_bounds", bounds)
    for run in (queries.kmeans_palette, queries.cluster_quantize, queries.foreground_bounds):
        with pytest.raises(Seen):
            run(spark, sf_dir)
    assert asked == [30, 30, spark.read.parquet(f"{sf_dir}/events.parquet").count()]


def test_draw_list_of_empty_cells(spark, palette):
    rows = {(r["cx"], r["cy"]): r for r in render.draw_list(bead_grid(spark, [["R", None]]), palette, 10, round_=True).collect()}
    assert rows[1, 0]["fill_hex"] == render.EMPTY and rows[1, 0]["light_hex"] is None and rows[0, 0]["fill_hex"] == "#ff0000"


def test_svg_circles_lines_and_description(spark, palette):
    svg = render.svg_documents(bead_grid(spark, [["R", None]]), palette, 2, 1, 5).first()["svg"]
    assert '<circle cx="2.675" cy="2.775" r="2.1" fill="#000000" opacity="0.14"/><circle data-bead="TEST:R" cx="2.5" cy="2.5" r="2.1" fill="url(#bead-TEST-R)"/><circle cx="1.6" cy="1.5" r="0.75" fill="#ffffff" opacity="0.32"/>' in svg
    assert '<g shape-rendering="crispEdges"><path d="M0.5 0V5" stroke="#bfa883" stroke-width="1" opacity="0.42"/>' in svg and '<path d="M0 5.5H10"' in svg
    assert svg.endswith("<desc>Generated from photo with 2x1 cells</desc></svg>")
    bare = render.svg_documents(bead_grid(spark, [[None]]), palette, 1, 1, 5).first()["svg"]
    assert "<defs></defs>" in bare and "<circle" not in bare


def test_frame(spark):
    rows = render.frame(spark, 3, 2, 40, labels=True).collect()
    assert [sum(r["kind"] == k for r in rows) for k in ("line", "x_label", "y_label")] == [7, 3, 2]
    assert {r["size"] for r in rows if r["kind"] == "line"} == {2.0} and {r["size"] for r in rows if r["kind"] != "line"} == {18.0}
    assert render.frame(spark, 3, 2, 40, round_=True).count() == 0


def test_ranks_collate_keys(spark):
    rows = [(1, k, "T", k, 5, 1) for k in ("a:1", "B:1", "a-b:1", "C:1", "é:1", "f:1")]
    stats = spark.createDataFrame(rows, "image_id long, color_key string, brand string, code string, total long, board_count long")
    ranked = assembly.ranked(stats).orderBy("by_total").collect()
    order = [r["color_key"] for r in ranked]
    assert order.index("B:1") > order.index("a:1") and order.index("é:1") < order.index("f:1") and [r["by_board"] for r in ranked] == [1, 2, 3, 4, 5, 6]


def test_reports_keep_the_first_seen_of_equals_first(spark, palette):
    beads = bead_grid(spark, [["W", "R", "B"], ["B", "R", "W"], ["K", "K", "K"]])
    report = render.count_report(quantise.counts(beads, first=True), palette).orderBy("place").collect()
    assert [r["code"] for r in report] == ["K", "W", "R", "B"]


def test_requantise_samples_nothing_again(spark, palette):
    made = pattern.make_pattern(image(spark, 8, 8, lambda x, y: (30 * x, 0, 30 * y, 255)), palette, Config(8, 8))
    again = pattern.requantise(made, palette, max_colors=1)
    assert again.cells is made.cells and again.counts.groupBy().sum("n").first()[0] == 64 and again.counts.count() == 1 < made.counts.count()
    assert pattern.used_palette(again, palette).count() == 1
    cells, frame = pattern.preview(made, palette, 20)
    assert cells.count() == 64 and frame.count() > 0
    with pytest.raises(ValueError):
        pattern.requantise(made, palette, width=9)


def isolated_by_force(grid_, passes=2):
    """Left, right, up, down; later cells see what earlier ones became."""
    grid_ = dict(grid_)
    for _ in range(passes):
        for (cy, cx), own in sorted(grid_.items()):
            near = [n for n in (grid_.get(p) for p in ((cy, cx - 1), (cy, cx + 1), (cy - 1, cx), (cy + 1, cx))) if n]
            if own and near and own not in near:
                grid_[cy, cx] = max(near, key=lambda n: (near.count(n), -near.index(n)))
    return grid_


def test_isolated_points_by_force(spark, sf_dir):
    beads = queries.beads(spark, sf_dir).select("image_id", "cx", "cy", "brand", "code").cache()
    key = lambda r: (r["brand"], r["code"]) if r["code"] else None
    by_image = {}
    for r in beads.collect():
        by_image.setdefault(r["image_id"], {})[r["cy"], r["cx"]] = key(r)
    got = {}
    for r in cleanup.clean_isolated(beads).collect():
        got.setdefault(r["image_id"], {})[r["cy"], r["cx"]] = key(r)
    assert got == {k: isolated_by_force(v) for k, v in by_image.items()} and got != by_image


def flood_by_force(image_, tolerance):
    """From each border pixel in turn, depth first, the colour that a path began with."""
    alpha = {p: v[3] for p, v in image_.items()}
    width, height = max(x for x, _ in image_) + 1, max(y for _, y in image_) + 1
    border = [(x, y) for x in range(width) for y in (0, height - 1)] + [(x, y) for y in range(height) for x in (0, width - 1)]
    todo, seen = [], set()
    for p in border:
        if p not in seen:
            seen.add(p)
            todo.append((p, image_[p][:3]))
    while todo:
        (x, y), seed = todo.pop()
        for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if p in image_ and p not in seen and sum(abs(a - b) for a, b in zip(image_[p], seed, strict=False)) <= 3 * tolerance:
                seen.add(p)
                todo.append((p, seed))
    opaque = [p for p, a in alpha.items() if a >= 128]
    if not opaque or sum(p in seen for p in opaque) / len(opaque) > 0.98:
        return alpha
    return {p: 0 if p in seen else a for p, a in alpha.items()}


def test_flood_fill_by_force(spark, sf_dir):
    whole = geometry.resize(queries.pixels(spark, sf_dir), 30, 30).cache()
    images, got = {}, {}
    for r in whole.collect():
        images.setdefault(r["image_id"], {})[r["x"], r["y"]] = (r["r"], r["g"], r["b"], r["a"])
    for r in photo.flood_fill_background(whole, 16).collect():
        got.setdefault(r["image_id"], {})[r["x"], r["y"]] = r["a"]
    assert got == {k: flood_by_force(v, 16) for k, v in images.items()}


def test_dither_by_force(spark, sf_dir):
    """Error diffusion over whole images, with the column functions' distances."""
    cells = queries.cells(spark, sf_dir).cache()
    palette = queries.brand_palette(spark, sf_dir)
    reduced = quantise.reduced_palettes(cells, palette, queries.COLORS).join(palette.select("ord", "r", "g", "b"), "ord").collect()
    got = {(r["image_id"], r["cx"], r["cy"]): r["code"] for r in queries.dither(spark, sf_dir).collect()}
    images = {}
    for r in cells.collect():
        images.setdefault(r["image_id"], {})[r["cx"], r["cy"]] = None if r["r"] is None else [float(r["r"]), float(r["g"]), float(r["b"])]
    for image_id, work in images.items():
        own = sorted((r for r in reduced if r["image_id"] == image_id), key=lambda r: r["rank"])
        labs = [(r["lab_l"], r["lab_a"], r["lab_b"]) for r in own]
        for cx, cy in sorted(work, key=lambda p: (p[1], p[0])):
            now = work[cx, cy]
            if now is None:
                assert got[image_id, cx, cy] is None
                continue
            now = [min(255.0, max(0.0, c)) for c in now]
            lab = quantise._lab(quantise.np.array(now))
            apart = [float(quantise.delta_e(lab, quantise.np.array(p))) for p in labs]
            best = own[apart.index(min(apart))]
            assert got[image_id, cx, cy] == best["code"]
            for dx, dy, part in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if (to := work.get((cx + dx, cy + dy))) is not None:
                    for k, c in enumerate("rgb"):
                        to[k] += (now[k] - best[c]) * 0.75 * part / 16


def test_kmeans_by_force(spark, sf_dir):
    """Lloyd's steps replayed from the same seeds, over every cell instead of weighted colours."""
    cells = queries.cells(spark, sf_dir).where("r is not null").cache()
    weights = cells.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("w"))
    points = clustering.color.with_lab(weights)
    first = clustering.seeds(points, 6).collect()
    assert len({(r["image_id"], r["p_l"], r["p_a"], r["p_b"]) for r in first}) == len(first) == 6 * cells.select("image_id").distinct().count()
    _, labels = clustering.kmeans(cells, 6)
    got = {(r["image_id"], r["r"], r["g"], r["b"]): r["label"] for r in labels.collect()}
    np = quantise.np
    for image_id in {r["image_id"] for r in first}:
        own = [r for r in points.where(F.col("image_id") == image_id).collect() for _ in range(r["w"])]
        lab = np.array([(r["lab_l"], r["lab_a"], r["lab_b"]) for r in own])
        centres = np.array([(r["p_l"], r["p_a"], r["p_b"]) for r in sorted((r for r in first if r["image_id"] == image_id), key=lambda r: r["label"])])
        was = None
        for _ in range(30):
            now = np.array([quantise.delta_e(x, centres).argmin() for x in lab])
            if was is not None and (now == was).all():
                break
            was = now
            centres = np.array([lab[now == k].mean(axis=0) if (now == k).any() else c for k, c in enumerate(centres)])
        assert [got[image_id, r["r"], r["g"], r["b"]] for r in own] == was.tolist()


def lab_of(row):
    return quantise._lab(quantise.np.array([row["r"], row["g"], row["b"]], float))


def nearest_by_force(lab, own):
    """The first of the nearest in a list of (palette row, Lab)."""
    apart = [float(quantise.delta_e(lab, p)) for _, p in own]
    return own[apart.index(min(apart))]


def by_image(rows):
    """The rows of each image in the order of their cells."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["image_id"], r["cy"], r["cx"])):
        out.setdefault(r["image_id"], []).append(r)
    return out


def reduced_by_force(cells, own, most):
    """code or None of each cell: every cell is matched, and again with the most frequent
    colours, first seen first, if there are more than ``most``."""
    labs = [None if c["r"] is None else lab_of(c) for c in cells]
    first = [None if lab is None else nearest_by_force(lab, own) for lab in labs]
    seen = {}
    for p in first:
        if p:
            seen.setdefault(p[0]["ord"], [0, len(seen), p])[0] += 1
    if len(seen) > most:
        own = [p for _, _, p in sorted(seen.values(), key=lambda s: (-s[0], s[1]))[:most]]
        first = [None if lab is None else nearest_by_force(lab, own) for lab in labs]
    return [p and p[0]["code"] for p in first]


def counted(found):
    out = {}
    for image_id, codes_ in found.items():
        for c in codes_:
            if c:
                out[image_id, c] = out.get((image_id, c), 0) + 1
    return out


def test_patterns_by_force(spark, sf_dir):
    """The registered plan and its second palette, matched cell by cell from the sampled cells."""
    config = config_for("subject", width=16, height=12, max_colors=10)
    made = pattern.make_pattern(queries.pixels(spark, sf_dir), queries.brand_palette(spark, sf_dir), config)
    cells = by_image(made.cells.collect())
    for query, brand, most in ((queries.photo_to_pattern, queries.BRAND, 10), (queries.requantize, "Brand#24", 4)):
        own = [(p, lab_of(p)) for p in palettes.of_brand(queries.palette(spark, sf_dir), brand).orderBy("ord").collect()]
        got = {(r["image_id"], r["code"]): r["n"] for r in query(spark, sf_dir).collect()}
        assert got and got == counted({k: reduced_by_force(v, own, most) for k, v in cells.items()})


def test_cluster_quantise_by_force(spark, sf_dir):
    """From the clusters' centres: their beads, every cell's nearest of them, then confetti."""
    cells = queries.cells(spark, sf_dir).cache()
    palette = [(p, lab_of(p)) for p in queries.brand_palette(spark, sf_dir).orderBy("ord").collect()]
    centres = {}
    for r in clustering.kmeans(cells, 8)[0].orderBy("label").collect():
        centres.setdefault(r["image_id"], []).append(quantise.np.array([r["p_l"], r["p_a"], r["p_b"]]))
    got = {k: [r["code"] for r in v] for k, v in by_image(queries.cluster_quantize(spark, sf_dir).collect()).items()}
    assert len(got) > 1 and any(c for v in got.values() for c in v)
    for image_id, rows in by_image(cells.collect()).items():
        own = list({p[0]["ord"]: p for p in (nearest_by_force(c, palette) for c in centres[image_id])}.values())
        found = [None if r["r"] is None else nearest_by_force(lab_of(r), own) for r in rows]
        order = [p for p in found if p]
        seen = list({p[0]["ord"]: p for p in order}.values())
        count = {p[0]["ord"]: sum(q[0]["ord"] == p[0]["ord"] for q in order) for p in seen}
        kept = [p for p in seen if count[p[0]["ord"]] / len(order) >= 0.02]
        if kept:
            found = [p if p is None or count[p[0]["ord"]] / len(order) >= 0.02 else nearest_by_force(p[1], kept) for p in found]
        assert got[image_id] == [p and p[0]["code"] for p in found]


def test_centres_meet_a_large_palette_by_lightness(spark, monkeypatch):
    """A palette that isn't broadcast: the first of the nearest, from a part of all pairs."""
    rows = [("T", f"c{k}", k, *(k % 700 * n % 256 for n in (37, 91, 151))) for k in range(800)]  # the last hundred repeat colours
    palette = spark.createDataFrame(rows, "brand string, code string, ord int, r int, g int, b int")
    spots = [(k // 4, k % 4, k * 17 % 100 + 0.25, k * 29 % 120 - 60.5, k * 43 % 120 - 60.5) for k in range(120)]
    centres = spark.createDataFrame(spots, "image_id long, label int, p_l double, p_a double, p_b double")
    measured, real = [], clustering.color.with_delta_e
    monkeypatch.setattr(clustering.color, "with_delta_e", lambda df, *names: measured.append(df.count()) or real(df, *names))
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 100)
    got = {(r["image_id"], r["label"]): r["code"] for r in clustering._cluster_beads(centres, palette).collect()}
    own = [(p, lab_of(p)) for p in palette.orderBy("ord").collect()]
    assert got == {(image_id, label): nearest_by_force(quantise.np.array(lab), own)[0]["code"] for image_id, label, *lab in spots}
    assert 0 < sum(measured) < 0.5 * len(spots) * len(rows)


def test_images_go_on_over_batches(spark, sf_dir):
    cells, size = queries.cells(spark, sf_dir).cache(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = [sorted(tuple(r) for r in found.collect()) for found in clustering.kmeans(cells, 6)]
    spark.conf.set(size, 7)
    try:
        assert whole == [sorted(tuple(r) for r in found.collect()) for found in clustering.kmeans(cells, 6)]
    finally:
        spark.conf.unset(size)


def test_cells_and_their_clusters_beads_are_made_once(spark, palette, monkeypatch):
    made = {"cells": spark.sparkContext.accumulator(0), "beads": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        total = made[name]

        def run(batches):
            for batch in batches:
                total.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    cells = counted(grid(spark, [[RED, BLUE, GREEN], [RED, (250, 0, 0), None], [BLUE, RED, GREEN]]), "cells")
    nearest = clustering.nearest
    monkeypatch.setattr(clustering, "nearest", lambda *asked: counted(nearest(*asked), "beads"))
    out = codes(clustering.cluster_quantise(cells, palette, 3, snap=True, confetti_ratio=0.02))
    assert out == [["R", "B", "G"], ["R", "R", None], ["B", "R", "G"]]
    assert {name: total.value for name, total in made.items()} == {"cells": 9, "beads": 3}
