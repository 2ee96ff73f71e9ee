"""The registered queries, over pixels made from events and a palette made from part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color, strings
from tessella.operators import assembly, cleanup, clustering, geometry, matching, photo, pooling, quantise, raster, render, replacement, resample
from tessella.operators.lineage import shared_folder
from tessella.plans import pattern
from tessella.plans.config import config_for
from tessella.sources import images, palettes

#: 10 x 10 cells of 5 x 5 pixels.
GRID, MASK, THRESHOLD, COLORS = 10, 0xF0, 0.7, 12
BRAND = "Brand#13"
PIXEL = ("image_id", "x", "y", "r", "g", "b", "a")

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTERED[f.__name__] = f
    return f


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.pixels_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.palette_of_parts(spark.read.parquet(f"{sf_dir}/part.parquet"))


def brand_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palette that beads come from: the colours of one brand."""
    return palettes.of_brand(palette(spark, sf_dir), BRAND)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.mode_downsample(pixels(spark, sf_dir), GRID, GRID, THRESHOLD, MASK)


def beads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.quantise(cells(spark, sf_dir), brand_palette(spark, sf_dir), COLORS)


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and the size of its bead grid."""
    return beads(spark, sf_dir).groupBy("image_id").agg((F.max("cx") + 1).alias("width"), (F.max("cy") + 1).alias("height"))


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements for every seventh colour: the colour after it in the palette."""
    own = palette(spark, sf_dir)
    after = own.select((F.col("ord") - 1).alias("ord"), F.col("brand").alias("new_brand"), F.col("code").alias("new_code"))
    return own.where("ord % 7 = 0").join(after, "ord").select(color.color_key(F.col("brand"), F.col("code")).alias("color_key"), F.col("new_brand").alias("brand"), F.col("new_code").alias("code"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


@query
def hex_rgb_roundtrip(spark, sf_dir):
    p = palette(spark, sf_dir).withColumn("hex", color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))
    r, g, b = color.hex_to_rgb_strict(F.col("hex"))
    return p.select("ord", "hex", r.alias("r"), g.alias("g"), b.alias("b"))


@query
def rgb_to_lab(spark, sf_dir):
    return rounded(color.with_lab(palette(spark, sf_dir)).select("ord", "lab_l", "lab_a", "lab_b"), "lab_l", "lab_a", "lab_b")


@query
def lab_to_rgb(spark, sf_dir):
    lab = color.with_lab(palette(spark, sf_dir)).drop("r", "g", "b")
    return color.with_rgb(lab).select("ord", "r", "g", "b")


@query
def delta_e_pairs(spark, sf_dir):
    """Every palette colour against the next three."""
    lab = color.with_lab(palette(spark, sf_dir)).select("ord", "lab_l", "lab_a", "lab_b")
    steps = lab.select(F.col("ord").alias("one"), "lab_l", "lab_a", "lab_b", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3)))).alias("k"))
    other = lab.select(F.col("ord").alias("two"), *(F.col(f"lab_{c}").alias(f"p_{c}") for c in "lab"))
    pairs = steps.withColumn("two", F.col("one") + F.col("k")).join(other, "two")
    return rounded(color.with_delta_e(pairs, matching.LAB, ("p_l", "p_a", "p_b")).select("one", "two", "delta_e"), "delta_e")


@query
def posterize(spark, sf_dir):
    return photo.posterize(pixels(spark, sf_dir), 8).select("image_id", "seq", "r", "g", "b", "a")


@query
def mask_quantize(spark, sf_dir):
    return photo.mask(pixels(spark, sf_dir), 0xF8).select("image_id", "seq", "r", "g", "b")


@query
def luma_contrast(spark, sf_dir):
    r, g, b, a = (F.col(c) for c in "rgba")
    return pixels(spark, sf_dir).select("image_id", "seq", F.round(color.grey(r, g, b, a), 6).alias("grey"), color.text_color(r, g, b).alias("text_hex"))


@query
def adjust_color(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    hexed = lambda by: color.rgb_to_hex(*(color.adjust(c, by) for c in (r, g, b)))
    return palette(spark, sf_dir).select("ord", hexed(20).alias("light_hex"), hexed(-35).alias("dark_hex"), color.color_key(F.col("brand"), F.col("code")).alias("color_key"), color.color_label(F.col("brand"), F.col("code"), F.col("name")).alias("label"))


@query
def palette_by_brand(spark, sf_dir):
    return brand_palette(spark, sf_dir).select("brand", "code", "name", "ord")


@query
def palette_fallback_brand(spark, sf_dir):
    return palettes.of_brand_or_first(palette(spark, sf_dir), "no such brand").select("brand", "code", "ord")


@query
def palette_upsert(spark, sf_dir):
    own = palette(spark, sf_dir).select("brand", "code", "name", "ord")
    new = own.where("ord % 5 = 0").select("brand", "code", F.concat(F.lit("new "), "name").alias("name"), (F.col("ord") + 10**8).alias("ord"))
    added = own.where("ord % 50 = 1").select("brand", F.concat("code", F.lit("x")).alias("code"), "name", (F.col("ord") + 2 * 10**8).alias("ord"))
    return palettes.upsert(own, new.unionByName(added))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as cards; a brand's name without what a file's name can't hold."""
    own = palette(spark, sf_dir)
    hexed = F.upper(color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))
    name = F.when(F.col("ord") % 7 != 0, F.col("name"))
    return own.select(F.replace("brand", F.lit("#"), F.lit("-")).alias("brand"), "code", name.alias("name"), hexed.alias("rgbHex"), F.lit("part").alias("source"), (F.col("ord") % 3 == 0).alias("isApproximate"), "ord")


@query
def json_cards(spark, sf_dir):
    """Palette files, one a brand, written and read, numbered over all brands."""
    path = shared_folder(spark, "brands")
    palettes.write_brand_files(cards(spark, sf_dir), path)
    return palettes.with_channels(palettes.numbered(palettes.read_json_cards(spark, path))).select("id", "brand", "code", "name", "source", "isApproximate", "ord", "r", "g", "b")


@query
def csv_cards(spark, sf_dir):
    """Cards of CSV files without a header, written and read."""
    path = shared_folder(spark, "csv")
    own = palette(spark, sf_dir)
    own.select("code", "name", "r", "g", "b").write.option("quote", "").csv(path)
    return palettes.read_csv_cards(spark, path, "csv", "acme").select("brand", "code", "name", "rgbHex", "source", "isApproximate")


@query
def json_array_cards(spark, sf_dir):
    """All cards as one JSON array over several files, written and read."""
    path = shared_folder(spark, "array")
    own = cards(spark, sf_dir).withColumnRenamed("ord", "id")
    palettes.write_json_array(own, path)
    return palettes.read_json_array(spark, path, "id int, " + palettes.CARD_SCHEMA + ", brand string").select("id", "brand", *(c.split()[0] for c in palettes.CARD_SCHEMA.split(", ")))


@query
def palette_table(spark, sf_dir):
    """A stored table of cards after two upserts: which cards and versions it holds."""
    path = shared_folder(spark, "palette")
    own = cards(spark, sf_dir)
    palettes.upsert_table(spark, path, own)
    new = own.where("brand < 'Brand-3' and ord % 5 = 0").withColumn("name", F.concat(F.lit("new "), "code"))
    same = own.where("brand >= 'Brand-3' and ord % 5 = 1")
    return palettes.upsert_table(spark, path, new.unionByName(same)).select("brand", "code", "name", "rgbHex", "ord", "version")


@query
def collated_ranks(spark, sf_dir):
    """Keys in mixed case by Unicode collation, where totals are equal."""
    key = F.when(F.col("ord") % 3 == 0, F.upper("name")).when(F.col("ord") % 3 == 1, F.initcap("name")).otherwise(F.col("name"))
    own = palette(spark, sf_dir).select(F.substring("brand", 7, 2).cast("int").alias("image_id"), F.concat(key, F.lit(":"), F.col("r").cast("string"), F.lit(" "), "ord").alias("color_key"), (F.col("b") % 4).alias("total"), (F.col("g") % 3).alias("board_count"))
    return assembly.ranked(own)


@query
def foreground_bounds(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return geometry.foreground_bounds(p.withColumn("a", F.when(F.col("x").between(7, 31) & (F.col("y") > 4), F.col("a")).otherwise(0)))


@query
def trim_foreground(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return geometry.trim_foreground(p.withColumn("a", F.when(F.col("x").between(7, 31) & F.col("y").between(5, 40), F.col("a")).otherwise(0))).select(*PIXEL)


@query
def resize_cover_nearest(spark, sf_dir):
    return geometry.resize(pixels(spark, sf_dir), 40, 28, "cover").select(*PIXEL)


@query
def resize_contain_nearest(spark, sf_dir):
    return geometry.resize(pixels(spark, sf_dir), 40, 28, "contain").select(*PIXEL)


@query
def resize_cover_lanczos(spark, sf_dir):
    return resample.resize_lanczos(pixels(spark, sf_dir), 40, 28).select(*PIXEL)


@query
def oriented(spark, sf_dir):
    """Every image turned from one of the eight orientations."""
    return geometry.oriented(pixels(spark, sf_dir), F.col("image_id") % 9).select(*PIXEL)


@query
def modulate(spark, sf_dir):
    return photo.modulate(pixels(spark, sf_dir), pattern.BRIGHTNESS, pattern.SATURATION, hue=30.0).select("image_id", "seq", "r", "g", "b", "a")


@query
def photo_cells(spark, sf_dir):
    """The whole way of a photo to its cells: upright, resampled, livened up, toned, posterised."""
    return pattern.photo_cells(geometry.oriented(pixels(spark, sf_dir), F.col("image_id") % 9), 24, 18)


@query
def subject_fill(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return geometry.subject_fill(p.withColumn("a", F.when(F.col("x").between(7, 31) & F.col("y").between(5, 40), F.col("a")).otherwise(0)), 36, 0.04).select(*PIXEL)


@query
def sobel_edges(spark, sf_dir):
    return rounded(photo.gradients(pixels(spark, sf_dir)), "magnitude")


@query
def enhance_edges(spark, sf_dir):
    return photo.enhance_edges(pixels(spark, sf_dir), 80, 0.7).select("image_id", "x", "y", "r", "g", "b", "a")


@query
def mode_downsample(spark, sf_dir):
    return cells(spark, sf_dir)


@query
def foreground_ratio(spark, sf_dir):
    return pooling.foreground_ratio(pixels(spark, sf_dir), 7, 9)


@query
def area_downsample(spark, sf_dir):
    return pooling.area_downsample(pixels(spark, sf_dir), 7, 9)


@query
def alpha_downsample(spark, sf_dir):
    return pooling.alpha_downsample(pixels(spark, sf_dir), 7, 9)


@query
def nearest_color(spark, sf_dir):
    found = matching.nearest(matching.distinct_colors(cells(spark, sf_dir)), brand_palette(spark, sf_dir))
    return rounded(found, "delta_e")


@query
def nearest_color_pruned(spark, sf_dir):
    """The whole part table as one palette, met by lightness instead of all with all."""
    found = matching.nearest_pruned(matching.distinct_colors(cells(spark, sf_dir)), palette(spark, sf_dir))
    return rounded(found, "delta_e")


@query
def reduced_palette_topk(spark, sf_dir):
    return quantise.reduced_palettes(cells(spark, sf_dir), brand_palette(spark, sf_dir), COLORS).select("image_id", "rank", "n", "brand", "code")


@query
def quantize_grid(spark, sf_dir):
    return beads(spark, sf_dir).select("image_id", "cx", "cy", "brand", "code")


@query
def bead_counts(spark, sf_dir):
    return quantise.counts(beads(spark, sf_dir))


@query
def bead_summary(spark, sf_dir):
    return rounded(quantise.summary(beads(spark, sf_dir)), "avg_delta_e")


@query
def confetti_cleanup(spark, sf_dir):
    return quantise.quantise(cells(spark, sf_dir), brand_palette(spark, sf_dir), COLORS, confetti_ratio=0.08).select("image_id", "cx", "cy", "brand", "code")


@query
def color_replacements(spark, sf_dir):
    return replacement.replace_colors(beads(spark, sf_dir).select("image_id", "cx", "cy", "brand", "code"), swaps(spark, sf_dir))


@query
def replacement_stats(spark, sf_dir):
    own = beads(spark, sf_dir)
    return rounded(replacement.replacement_stats(own.select("image_id", "cx", "cy", "brand", "code"), swaps(spark, sf_dir), quantise.summary(own)), "avg_delta_e")


@query
def board_regions(spark, sf_dir):
    """Boards of four cells a side of every image's own beads."""
    return geometry.boards_of(grids(spark, sf_dir), F.lit(4))


@query
def board_size_options(spark, sf_dir):
    """Boards of every size on offer for a grid a part, up to 256 cells a side."""
    own = palette(spark, sf_dir).select("ord", (F.col("r") + 1).alias("width"), (F.col("b") + 1).alias("height"))
    offered = own.withColumn("size", F.explode(F.array(*map(F.lit, geometry.BOARD_SIZES))))
    return geometry.boards_of(offered, F.col("size"))


@query
def cell_sizes(spark, sf_dir):
    """Cells for containers of many widths, and how far a job of many steps is."""
    width = (F.col("ord") * 37 % 1500 + 100).cast("int")
    return palette(spark, sf_dir).select("ord", geometry.cell_size(width, F.col("r") + 1).alias("cell"), geometry.progress(F.col("g"), F.col("r") + F.col("g")).alias("percent"))


@query
def board_color_stats(spark, sf_dir):
    return assembly.ranked(assembly.color_stats(beads(spark, sf_dir), palette(spark, sf_dir), 4, board=4))


@query
def board_totals(spark, sf_dir):
    return assembly.board_totals(beads(spark, sf_dir), 4)


@query
def row_bead_counts(spark, sf_dir):
    return assembly.row_counts(beads(spark, sf_dir), 3)


@query
def remaining_beads(spark, sf_dir):
    own = beads(spark, sf_dir)
    return assembly.remaining(own, own.where("(cx + cy) % 3 = 0").select("image_id", "cx", "cy")).select("image_id", "cx", "cy", "code")


@query
def count_report(spark, sf_dir):
    return render.count_report(quantise.counts(beads(spark, sf_dir), first=True), palette(spark, sf_dir))


@query
def draw_list(spark, sf_dir):
    return render.draw_list(beads(spark, sf_dir), palette(spark, sf_dir), 24, labels=True, round_=True)


@query
def pattern_frame(spark, sf_dir):
    """Lines and axis labels of every image's grid."""
    return render.frames(grids(spark, sf_dir), 24, labels=True)


@query
def pattern_raster(spark, sf_dir):
    """Square cells under grid lines, with room for the axes, as pixels."""
    return raster.raster(beads(spark, sf_dir), palette(spark, sf_dir), GRID, GRID, 8, labels=True).select(*PIXEL)


@query
def bead_raster(spark, sf_dir):
    """Round beads with shadow, gradient and highlight, as pixels."""
    return raster.raster(beads(spark, sf_dir), palette(spark, sf_dir), GRID, GRID, 12, round_=True).select(*PIXEL)


@query
def report_pages(spark, sf_dir):
    """Each brand's parts as a report that goes on over pages."""
    own = palette(spark, sf_dir).select(F.substring("brand", 7, 2).cast("int").alias("image_id"), "brand", "code", (F.col("r") + F.col("g")).alias("n"), F.struct("ord").alias("first_seen"))
    report = render.count_report(own, palette(spark, sf_dir))
    sizes = own.groupBy("image_id").agg((F.max("n") + 100).alias("width"), (F.min("n") + 200).alias("height"))
    return rounded(render.report_pages(report, sizes), "y")


@query
def page_layouts(spark, sf_dir):
    """A page for every palette colour's channels as the size of an image."""
    sized = palette(spark, sf_dir).select("ord", (F.col("r") + 1).alias("width"), (F.col("g") + 1).alias("height"))
    return rounded(render.page_layout(sized), "image_width", "image_height")


@query
def lab_grid_to_rgb(spark, sf_dir):
    """The Lab of every part and its chroma once more half as strong again, in gamut and out."""
    lab = color.with_lab(palette(spark, sf_dir)).withColumn("strength", F.explode(F.array(F.lit(1.0), F.lit(1.5))))
    lab = lab.withColumns({f"lab_{c}": F.col(f"lab_{c}") * F.col("strength") for c in "ab"}).drop("r", "g", "b")
    return color.with_rgb(lab).select("ord", "strength", "r", "g", "b")


@query
def requantize(spark, sf_dir):
    """The sampled cells once more with fewer colours."""
    config = config_for("subject", width=16, height=12, max_colors=10)
    made = pattern.make_pattern(pixels(spark, sf_dir), brand_palette(spark, sf_dir), config)
    return pattern.requantise(made, palettes.of_brand(palette(spark, sf_dir), "Brand#24"), max_colors=4).counts


@query
def board_draw_list(spark, sf_dir):
    return render.board_draw_list(beads(spark, sf_dir), palette(spark, sf_dir), 4, 1, 1, 12)


@query
def svg_cells(spark, sf_dir):
    return render.svg_cells(beads(spark, sf_dir), palette(spark, sf_dir), 12)


@query
def bilateral_filter(spark, sf_dir):
    return photo.bilateral(pixels(spark, sf_dir), 1.0, 30.0).select(*PIXEL)


@query
def size_ratio_infer(spark, sf_dir):
    sized = palette(spark, sf_dir).select("ord", F.concat((F.col("r") * 17 + 5).cast("string"), F.when(F.col("g") % 2 == 0, "x").otherwise("X"), (F.col("b") * 19 + 3).cast("string")).alias("size"))
    w, h = strings.parse_size(F.col("size"))
    return sized.select("ord", "size", w.alias("width"), h.alias("height")).select("*", strings.resolution(F.col("width"), F.col("height")).alias("resolution"), strings.nearest_ratio(F.col("width"), F.col("height")).alias("ratio"))


@query
def text_digests(spark, sf_dir):
    name = F.col("name")
    return palette(spark, sf_dir).select("ord", strings.sha256_hex(name).alias("sha256"), strings.md5_hex(name).alias("md5"), strings.escape_xml(F.concat(F.lit('<a b="&">'), name)).alias("xml"), strings.gradient_id(F.col("brand"), F.col("code")).alias("gradient"), strings.as_string(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), strings.strip_slashes(F.concat(F.col("code"), F.lit("//"))).alias("bare"))


@query
def signed_messages(spark, sf_dir):
    """Keyed digests, data URLs there and back, query strings and numbers of every part."""
    name = F.col("name")
    url = strings.data_url(name.cast("binary"), "text/plain")
    keys = F.create_map(F.lit("name"), name, F.lit("code"), F.col("code"))
    number = F.when(F.col("ord") % 3 == 0, F.col("code")).otherwise(F.concat(F.col("ord").cast("string"), F.lit(".5")))
    return palette(spark, sf_dir).select(
        "ord",
        strings.hmac_sha256_hex(F.col("brand"), name).alias("mac"),
        strings.hmac_sha256_hex(F.repeat(name, 4), F.col("brand")).alias("mac_long"),
        url.alias("url"),
        strings.data_url_bytes(url).cast("string").alias("back"),
        strings.query_string(keys).alias("query"),
        strings.as_number(number).alias("number"),
    )


@query
def event_json_path(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", strings.json_path(F.col("props"), "$.k").alias("k"), strings.json_path(F.col("props"), "$.missing[0].x").alias("missing"))


@query
def dither(spark, sf_dir):
    return quantise.quantise(cells(spark, sf_dir), brand_palette(spark, sf_dir), COLORS, dither=0.75).select("image_id", "cx", "cy", "brand", "code")


@query
def isolated_points(spark, sf_dir):
    return cleanup.clean_isolated(beads(spark, sf_dir))


@query
def isolated_points_at_once(spark, sf_dir):
    return cleanup.clean_isolated_at_once(beads(spark, sf_dir).select("image_id", "cx", "cy", "brand", "code"))


@query
def flood_fill_background(spark, sf_dir):
    whole = geometry.resize(pixels(spark, sf_dir), 30, 30)
    return photo.flood_fill_background(whole, 16).select("image_id", "x", "y", "a")


@query
def kmeans_palette(spark, sf_dir):
    return clustering.cluster_palettes(cells(spark, sf_dir), brand_palette(spark, sf_dir), 8)


@query
def cluster_quantize(spark, sf_dir):
    return clustering.cluster_quantise(cells(spark, sf_dir), brand_palette(spark, sf_dir), 8, snap=True, confetti_ratio=0.02).select("image_id", "cx", "cy", "brand", "code")


@query
def tone_low_res(spark, sf_dir):
    """Per-channel tone, then every pixel as a posterised cell."""
    return photo.low_res_cells(photo.tone(pixels(spark, sf_dir), (1.06, 1.02, 0.94), (10, 6, 0)))


@query
def output_dimensions(spark, sf_dir):
    ratio = F.element_at(F.array(*map(F.lit, strings.RATIOS)), (F.col("ord") % 8 + 1).cast("int"))
    asked = F.when(F.col("ord") % 11 == 0, "5:4").otherwise(ratio)
    scale = F.element_at(F.array(F.lit("1k"), F.lit("2k"), F.lit("4k")), (F.col("ord") % 3 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit(" PNG "), F.lit("jpg"), F.lit("webp"), F.lit("gif")), (F.col("ord") % 4 + 1).cast("int"))
    link = F.when(F.col("ord") % 2 == 0, "HTTPS://x.example/a").otherwise("ftp://x.example/a")
    return palette(spark, sf_dir).select("ord", strings.dimensions(scale, asked).alias("size"), strings.image_format(kind).alias("format"), strings.is_image_input(link).alias("usable"))


@query
def svg_documents(spark, sf_dir):
    return render.svg_documents(beads(spark, sf_dir), palette(spark, sf_dir), GRID, GRID, 12)


@query
def photo_to_pattern(spark, sf_dir):
    """The whole plan with the subject preset on a small grid."""
    config = config_for("subject", width=16, height=12, max_colors=10)
    return pattern.make_pattern(pixels(spark, sf_dir), brand_palette(spark, sf_dir), config).counts
