"""Drawing patterns: scan conversion of cells, round beads and grid lines to pixels.

Every pixel is worked out for itself from the cell that it lies in, in Spark's own functions:
rectangles by place, circles and gradients by the pixel's middle, lines by the share of the pixel
that they cover.  No task holds an image.  The result is a pixel relation like those of the
image sources; text isn't drawn, since its shapes are the fonts' own (see ``draw_list``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import adjust, clamp, half_up
from tessella.operators.render import EMPTY, GRID_LINES, canvas_size, channels, label_size

Color = tuple[Column, Column, Column]

#: Of a round bead in parts of its radius. Shadow and highlight: offset right and
#: down, radius, grey, alpha.
SHADOW, HIGHLIGHT = (0.06, 0.1, 0.92, 0, 0.1), (-0.25, -0.28, 0.12, 255, 0.25)
#: The gradient's first circle (offset both ways, radius) and the bead's own radius.
SPOT, SPOT_RADIUS, BEAD_RADIUS = -0.3, 0.1, 0.9
#: Stops of the gradient and what each adds to the bead's channels.
STOPS = ((0.0, 20), (0.25, 0), (0.75, 0), (0.95, -20), (1.0, -35))


def constant(hex_: str) -> Color:
    return tuple(F.lit(float(int(hex_[k : k + 2], 16))) for k in (1, 3, 5))


def over(under: Color, paint: Color, alpha: Column) -> Color:
    return tuple(u + (p - u) * alpha for u, p in zip(under, paint, strict=True))


def within(dx: Column, dy: Column, radius: float) -> Column:
    return dx * dx + dy * dy <= F.lit(radius * radius)


def cone(dx: Column, dy: Column) -> Column:
    """The place (0 to 1) of a point on the gradient between the spot's and the bead's circle:
    the largest t whose circle goes through it.  Lengths are in radii."""
    px, py = dx - SPOT, dy - SPOT
    grows = BEAD_RADIUS - SPOT_RADIUS
    a = 2 * SPOT * SPOT - grows * grows  # negative: the spot lies inside the bead
    b = -SPOT * (px + py) + SPOT_RADIUS * grows
    c = px * px + py * py - SPOT_RADIUS * SPOT_RADIUS
    return clamp((b - F.sqrt(F.greatest(F.lit(0.0), b * b - a * c))) / a, 0.0, 1.0)


def ramp(t: Column, stops: Sequence[tuple[float, Color]]) -> Color:
    """The colour at ``t`` between stops."""
    out = stops[-1][1]
    for (low, first), (high, second) in reversed(list(zip(stops, stops[1:], strict=False))):
        share = (t - low) / F.lit(high - low)
        out = tuple(F.when(t <= high, f + (s - f) * share).otherwise(o) for f, s, o in zip(first, second, out, strict=True))
    return out


def _bead(under: Color, rgb: Color, dx: Column, dy: Column) -> Color:
    """A round bead at (dx, dy) radii from its middle."""
    x, y, radius, grey, alpha = SHADOW
    shade = F.when(within(dx - x, dy - y, radius), F.lit(alpha)).otherwise(0.0)
    drawn = over(under, constant("#" + f"{grey:02x}" * 3), shade)
    stops = [(at, tuple(adjust(c, by).cast("double") for c in rgb)) for at, by in STOPS]
    inside = within(dx, dy, BEAD_RADIUS)
    drawn = tuple(F.when(inside, own).otherwise(c) for own, c in zip(ramp(F.col("__t"), stops), drawn, strict=True))
    x, y, radius, grey, alpha = HIGHLIGHT
    shine = F.when(within(dx - x, dy - y, radius), F.lit(alpha)).otherwise(0.0)
    return over(drawn, constant("#" + f"{grey:02x}" * 3), shine)


def _lined(under: Color, along: str, across: str, margin: int, cell: int, lines: int, length: int) -> Color:
    """Grid lines across one axis, painted over: of the two lines next to a pixel the share of
    it that each covers."""
    half = max(1, int(cell / 20 + 0.5)) / 2
    first = F.floor((F.col(along) - margin) / F.lit(cell))
    spans = F.col(across).between(margin, margin + length - 1)
    for k in (first, first + 1):
        middle = k * cell + margin
        covered = F.greatest(F.lit(0.0), F.least(F.col(along) + 1.0, middle + half) - F.greatest(F.col(along) + 0.0, middle - half))
        under = over(under, constant(GRID_LINES), F.when(spans & k.between(0, lines), covered).otherwise(0.0))
    return under


def raster(beads: DataFrame, palette: DataFrame, width: int, height: int, cell: int, grid: bool = True, labels: bool = False, round_: bool = False, background: str = "#ffffff") -> DataFrame:
    """image_id, x, y, r, g, b, a, width, height: the drawing of every pattern of width x height
    cells.  ``labels`` leaves room for the axes; round beads are drawn without grid lines."""
    margin = label_size(cell, labels)
    right, low = canvas_size(width, height, cell, labels)
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    own = beads.select("image_id", "cx", "cy", "brand", "code").join(channels(palette), ["brand", "code"], "left")
    inner = own.withColumn("dx", F.explode(steps(cell))).withColumn("dy", F.explode(steps(cell)))
    place = lambda c, d: (F.col(c) * cell + F.col(d) + margin).cast("int")
    inner = inner.select("image_id", place("cx", "dx").alias("x"), place("cy", "dy").alias("y"), F.lit(True).alias("cell"), F.col("code").isNotNull().alias("shown"), "dx", "dy", *(F.col(c).cast("double").alias(c) for c in "rgb"))
    beside = F.lit([k for k in range(right) if not margin <= k < margin + width * cell])
    columns = F.when(F.col("y").between(margin, margin + height * cell - 1), beside).otherwise(steps(right))
    outer = beads.select("image_id").distinct().withColumn("y", F.explode(steps(low))).withColumn("x", F.explode(columns))
    none = F.lit(None)
    outer = outer.select("image_id", "x", "y", F.lit(False).alias("cell"), F.lit(False).alias("shown"), *(none.cast("int").alias(c) for c in ("dx", "dy")), *(none.cast("double").alias(c) for c in "rgb"))
    pixels = inner.unionByName(outer)
    paper, rgb = constant(background), tuple(F.col(c) for c in "rgb")
    radius = (cell - 2) / 2
    empty = constant(EMPTY)
    if round_ and radius > 0:
        pixels = pixels.withColumns({d: (F.col(d) + 0.5 - cell / 2) / F.lit(radius) for d in ("dx", "dy")})
        pixels = pixels.withColumn("__t", cone(F.col("dx"), F.col("dy")))
        filled = _bead(paper, rgb, F.col("dx"), F.col("dy"))
    else:
        filled = paper if round_ else rgb
    known = F.col("shown") & F.col("r").isNotNull()  # a colour that the palette lacks is drawn as an empty cell
    drawn = tuple(F.when(known, f).when(F.col("cell"), e).otherwise(p) for f, e, p in zip(filled, empty, paper, strict=True))
    if grid and not round_:
        pixels = pixels.withColumns({f"__{c}": v for c, v in zip("rgb", drawn, strict=True)})
        drawn = _lined(tuple(F.col(f"__{c}") for c in "rgb"), "x", "y", margin, cell, width, height * cell)
        pixels = pixels.withColumns({f"__{c}": v for c, v in zip("rgb", drawn, strict=True)})
        drawn = _lined(tuple(F.col(f"__{c}") for c in "rgb"), "y", "x", margin, cell, height, width * cell)
    channel = (half_up(clamp(F.round(v, 6))).alias(c) for c, v in zip("rgb", drawn, strict=True))
    return pixels.select("image_id", "x", "y", *channel, F.lit(255).alias("a"), F.lit(right).alias("width"), F.lit(low).alias("height"))
