"""Patterns as data: draw lists, report tables and SVG."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import color, strings

#: Colours of empty cells, paper and its lines, grid lines and labels.
EMPTY, PAPER, LINES, GRID_LINES, LABELS = "#f9fafb", "#f4dfb7", "#bfa883", "#9ca3af", "#374151"


def label_size(cell: int, labels: bool) -> int:
    return max(18, cell) if labels else 0


def canvas_size(width: int, height: int, cell: int, labels: bool = False) -> tuple[int, int]:
    margin = label_size(cell, labels) + 2
    return width * cell + margin, height * cell + margin


def channels(palette: DataFrame) -> DataFrame:
    return palette.select("brand", "code", "r", "g", "b").dropDuplicates(["brand", "code"])


def draw_list(beads: DataFrame, palette: DataFrame, cell: int, labels: bool = False, round_: bool = False) -> DataFrame:
    """image_id, cx, cy, px, py, fill_hex, label, text_hex of every cell; round beads also have
    the stops of their gradient, light_hex and dark_hex."""
    margin = label_size(cell, labels)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    found = beads.select("image_id", "cx", "cy", "brand", "code").join(channels(palette), ["brand", "code"], "left")
    stops = {"light_hex": 20, "dark_hex": -35} if round_ else {}
    return found.select(
        "image_id",
        "cx",
        "cy",
        (F.col("cx") * cell + margin).alias("px"),
        (F.col("cy") * cell + margin).alias("py"),
        F.when(r.isNotNull(), color.rgb_to_hex(r, g, b)).otherwise(EMPTY).alias("fill_hex"),
        F.col("code").alias("label"),
        F.when(F.col("code").isNotNull(), color.text_color(r, g, b)).alias("text_hex"),
        *(F.when(r.isNotNull(), color.rgb_to_hex(*(color.adjust(c, by) for c in (r, g, b)))).alias(name) for name, by in stops.items()),
    )


def board_draw_list(beads: DataFrame, palette: DataFrame, size: int, board_row: int, board_col: int, cell: int, selected: str | None = None) -> DataFrame:
    """The draw list of one board: places count from the board's corner, axis labels from 1 in
    the whole pattern; with a selected colour key, the others are dimmed."""
    on = beads.where((F.floor(F.col("cy") / size) == board_row) & (F.floor(F.col("cx") / size) == board_col))
    rows = draw_list(on, palette, cell)
    key = on.select("image_id", "cx", "cy", color.color_key(F.col("brand"), F.col("code")).alias("key"))
    lit = F.lit(True) if selected is None else F.coalesce(F.col("key") == selected, F.lit(False))
    out = rows.join(key, ["image_id", "cx", "cy"])
    return out.select("image_id", "cx", "cy", (F.col("px") - board_col * size * cell).alias("px"), (F.col("py") - board_row * size * cell).alias("py"), "fill_hex", "label", "text_hex", (F.col("cx") + 1).alias("x_label"), (F.col("cy") + 1).alias("y_label"), lit.alias("highlighted"))


def count_report(counts: DataFrame, palette: DataFrame) -> DataFrame:
    """Counts with the palette's names, empty where it has none; counts with ``first_seen``
    also get their place in the report, by n, the first seen of equals first."""
    names = palette.groupBy("brand", "code").agg(F.min_by("name", "ord").alias("name"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "first_seen")  # one row a colour
    place = [F.row_number().over(order).alias("place")] * ("first_seen" in counts.columns)
    return counts.join(names, ["brand", "code"], "left").select("image_id", "brand", "code", F.coalesce("name", F.lit("")).alias("name"), "n", *place)


def frame(spark: SparkSession, width: int, height: int, cell: int, labels: bool = False, round_: bool = False) -> DataFrame:
    """What a pattern's drawing has besides its cells: kind, text, x1, y1, x2, y2, size,
    color_hex.  Lines (none with round beads) have their width as size, axis labels that of
    their font, and their middle at both ends."""
    margin = label_size(cell, labels)
    font = max(12.0, min(18.0, cell / 1.4))
    line = float(max(1, int(cell / 20 + 0.5)))
    at, half = F.col("id") * cell + F.lit(float(margin)), cell / 2

    def rows(n: int, kind: str, text, x1, y1, x2, y2, size: float, hex_: str) -> DataFrame:
        ends = (F.lit(v).cast("double").alias(k) if isinstance(v, (int, float)) else v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True))
        return spark.range(n).select(F.lit(kind).alias("kind"), text.alias("text"), *ends, F.lit(size).alias("size"), F.lit(hex_).alias("color_hex"))

    none, number = F.lit(None).cast("string"), (F.col("id") + 1).cast("string")
    out = []
    if not round_:
        out.append(rows(width + 1, "line", none, at, margin, at, margin + height * cell, line, GRID_LINES))
        out.append(rows(height + 1, "line", none, margin, at, margin + width * cell, at, line, GRID_LINES))
    if labels:
        out.append(rows(width, "x_label", number, at + half, margin / 2, at + half, margin / 2, font, LABELS))
        out.append(rows(height, "y_label", number, margin / 2, at + half, margin / 2, at + half, font, LABELS))
    return functools.reduce(DataFrame.unionByName, out) if out else rows(0, "line", none, 0, 0, 0, 0, line, GRID_LINES)


def frames(grids: DataFrame, cell: int, labels: bool = False, round_: bool = False) -> DataFrame:
    """``frame`` for every image of a table of grids (image_id, width, height in cells)."""
    margin = float(label_size(cell, labels))
    font, line, half = max(12.0, min(18.0, cell / 1.4)), float(max(1, int(cell / 20 + 0.5))), cell / 2

    def pieces(side: str, other: str, name: str) -> list[Column]:
        upto = lambda n: F.sequence(F.lit(0), F.col(side) + n)
        ends, middle = (F.lit(margin), F.col(other) * cell + margin), (F.lit(margin / 2), F.lit(margin / 2))
        lines = F.transform(upto(0), lambda k: _piece("line", None, name, k * cell + margin, ends, line, GRID_LINES))
        texts = F.transform(upto(-1), lambda k: _piece(f"{name}_label", (k + 1).cast("string"), name, k * cell + (margin + half), middle, font, LABELS))
        return [lines] * (not round_) + [texts] * labels

    kinds = pieces("width", "height", "x") + pieces("height", "width", "y")
    if not kinds:  # round beads without axes
        return frames(grids, cell, labels=True).where("false")
    return grids.select("image_id", F.inline(F.concat(*kinds)))


def _piece(kind: str, text: Column | None, axis: str, at: Column, ends: tuple[Column, Column], size: float, hex_: str) -> Column:
    """A line or label at a place of one axis, between two places of the other."""
    x1, x2, y1, y2 = (at, at, *ends) if axis == "x" else (*ends, at, at)
    values = {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if text is None else text).alias("text"), *(v.cast("double").alias(k) for k, v in values.items()), F.lit(size).alias("size"), F.lit(hex_).alias("color_hex"))


#: Points in a millimetre; of the report's table in points: the font's size, the
#: padding of a cell, the page's margin.  In mm: page margin and heading over the drawing, and
#: the gap below it.
POINTS, FONT, PADDING, TABLE_MARGIN = 72 / 25.4, 9, 5, 40
PAGE_MARGIN, HEADING, GAP = 15.0, 18.0, 8.0


def report_pages(report: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, page, y, kind, place, brand, code, name, n: the rows of a report (image_id,
    place, ...) laid on pages.  The table begins below the drawing (sizes: image_id, width,
    height in pixels) and goes on over the next page where the page is full, each time under a
    head row (kind ``head``); ``y`` is a row's upper edge in mm."""
    row, margin = (FONT * 1.15 + 2 * PADDING) / POINTS, TABLE_MARGIN / POINTS
    laid = page_layout(sizes).withColumn("begin", PAGE_MARGIN + HEADING + GAP + F.col("image_height"))
    rows = lambda begin: F.greatest(F.lit(0), F.floor((F.col("page_height") - margin - begin) / row) - 1).cast("int")
    laid = laid.select("image_id", "begin", rows(F.col("begin")).alias("first"), rows(F.lit(margin)).alias("later"))
    found = report.join(laid, "image_id")
    after = F.col("place") - F.col("first") - 1
    on_first = F.col("place") <= F.col("first")
    page = F.when(on_first, 1).otherwise(F.floor(after / F.col("later")) + 2).cast("int")
    line = F.when(on_first, F.col("place")).otherwise(after % F.col("later") + 1)
    top = F.when(on_first, F.col("begin")).otherwise(margin)
    head = lambda c, v: F.when(F.col("head"), F.lit(None)).otherwise(v).alias(c)
    found = found.withColumns({"page": page, "line": line, "top": top})
    found = found.withColumn("head", F.explode(F.when(F.col("line") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    y = F.col("top") + F.when(F.col("head"), 0.0).otherwise(F.col("line") * row)
    return found.select("image_id", "page", y.alias("y"), F.when(F.col("head"), "head").otherwise("row").alias("kind"), *(head(c, F.col(c)) for c in ("place", "brand", "code", "name", "n")))


def page_layout(sizes: DataFrame) -> DataFrame:
    """``page_geometry`` for a table of sizes (width, height)."""
    lying = F.col("width") > F.col("height")
    w, h = F.when(lying, 297.0).otherwise(210.0), F.when(lying, 210.0).otherwise(297.0)
    scale = F.least((w - 30.0) / F.col("width"), h * 0.55 / F.col("height"))
    return sizes.withColumns({"page_width": w, "page_height": h, "image_width": F.col("width") * scale, "image_height": F.col("height") * scale})


def page_geometry(width: int, height: int) -> dict[str, float]:
    """A4 page in mm for an image: lying if wider than high, image at most 55 % of the page."""
    page_w, page_h = (297.0, 210.0) if width > height else (210.0, 297.0)
    margin = 15.0
    scale = min((page_w - 2 * margin) / width, page_h * 0.55 / height)
    return {"page_width": page_w, "page_height": page_h, "image_width": width * scale, "image_height": height * scale}


def _plain(value: float) -> str:
    return str(float(value)).removesuffix(".0")


def _number(value: Column) -> Column:
    """A length as the shortest text of a double, whole numbers without a fraction."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def svg_cells(beads: DataFrame, palette: DataFrame, cell: int) -> DataFrame:
    """image_id, cx, cy, svg: of each bead its shadow, itself and its highlight."""
    found = beads.where("code is not null").join(channels(palette).select("brand", "code"), ["brand", "code"])
    x, y = (F.col(c) * F.lit(float(cell)) + cell / 2 for c in ("cx", "cy"))
    key = strings.escape_xml(color.color_key(F.col("brand"), F.col("code")))
    radius, shine = _plain(max(1, cell * 0.42)), _plain(max(0.75, cell * 0.08))
    circle = lambda x, y, r, rest, name=(): F.concat(F.lit("<circle"), *name, F.lit(' cx="'), _number(x), F.lit('" cy="'), _number(y), F.lit(f'" r="{r}" fill="'), rest)
    parts = [
        circle(x + cell * 0.035, y + cell * 0.055, radius, F.lit('#000000" opacity="0.14"/>')),
        circle(x, y, radius, F.concat(F.lit("url(#"), strings.gradient_id(F.col("brand"), F.col("code")), F.lit(')"/>')), (F.lit(' data-bead="'), key, F.lit('"'))),
        circle(x - cell * 0.18, y - cell * 0.2, shine, F.lit('#ffffff" opacity="0.32"/>')),
    ]
    return found.select("image_id", "cx", "cy", F.concat(*parts).alias("svg"))


def svg_documents(beads: DataFrame, palette: DataFrame, width: int, height: int, cell: int) -> DataFrame:
    """image_id, svg: one SVG text an image (its grid's size bounds it), beads in row order and
    one gradient a gradient id in the order first seen."""
    circles = svg_cells(beads, palette, cell)
    body = circles.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "svg"))), lambda s: s["svg"]), "").alias("body"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hexed = lambda by: color.rgb_to_hex(*(color.adjust(c, by) for c in (r, g, b)))
    stops = ((0, 34), (36, 0), (76, 0), (100, -36))
    name = strings.gradient_id(F.col("brand"), F.col("code"))
    gradient = F.concat(F.lit('<radialGradient id="'), name, F.lit('" cx="32%" cy="28%" r="68%">'), *(x for at, by in stops for x in (F.lit(f'<stop offset="{at}%" stop-color="'), hexed(by), F.lit('"/>'))), F.lit("</radialGradient>"))
    seen = beads.where("code is not null").groupBy("image_id", "brand", "code").agg(F.min(F.col("cy") * width + F.col("cx")).alias("first"))
    defs = seen.join(channels(palette), ["brand", "code"]).groupBy("image_id", name.alias("name")).agg(F.min(F.struct("first", gradient.alias("def"))).alias("d"))
    defs = defs.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda s: s["def"]), "").alias("defs"))
    w, h = width * cell, height * cell
    line = lambda d: f'<path d="{d}" stroke="{LINES}" stroke-width="1" opacity="0.42"/>'
    lines = "".join(line(f"M{_plain(x * cell + 0.5)} 0V{h}") for x in range(width + 1)) + "".join(line(f"M0 {_plain(y * cell + 0.5)}H{w}") for y in range(height + 1))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}"><defs>'
    rest = f'</defs><rect width="100%" height="100%" fill="{PAPER}"/><g shape-rendering="crispEdges">{lines}</g><g>'
    tail = f"</g><desc>Generated from photo with {width}x{height} cells</desc></svg>"
    images = beads.select("image_id").distinct()  # an image without beads has a page too
    whole = images.join(body, "image_id", "left").join(defs, "image_id", "left")
    return whole.select("image_id", F.concat(F.lit(head), F.coalesce("defs", F.lit("")), F.lit(rest), F.coalesce("body", F.lit("")), F.lit(tail)).alias("svg"))
