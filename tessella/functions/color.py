"""Colour math as column builders: hex, sRGB, CIELAB, CIEDE2000, luma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sRGB transfer, D65 white, CIELAB constants.
SRGB_LINEAR_FROM, LINEAR_SRGB_FROM = 0.04045, 0.0031308
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 0.008856, 903.3
#: Where the inverse's cubes begin, of f and of L.
CUBE_FROM, L_CUBE_FROM = 0.2068966, 8.0
LUMA = (0.299, 0.587, 0.114)


def half_up(value: Column) -> Column:
    """Round halves towards positive infinity, as an integer."""
    return F.floor(value + F.lit(0.5)).cast("int")


def clamp(value: Column, low: float = 0, high: float = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def hex_to_rgb(text: Column) -> tuple[Column, Column, Column]:
    """Three channels of '#rrggbb' or 'rrggbb'."""
    bare = F.regexp_replace(text, "^#", "")
    return tuple(F.conv(F.substring(bare, k, 2), 16, 10).cast("int") for k in (1, 3, 5))


def hex_to_rgb_strict(text: Column) -> tuple[Column, Column, Column]:
    """As hex_to_rgb, but anything else than six hexadecimal digits fails the query."""
    bare = F.regexp_replace(text, "^#", "")
    checked = F.when(bare.rlike("^[0-9a-fA-F]{6}$"), bare).otherwise(F.raise_error(F.concat(F.lit("not a colour: "), F.coalesce(text, F.lit("null")))))
    return hex_to_rgb(checked)


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(half_up(clamp(c)))), 2, "0") for c in (r, g, b)))


def to_linear(c: Column) -> Column:
    return F.when(c <= SRGB_LINEAR_FROM, c / 12.92).otherwise(F.power((c + 0.055) / 1.055, F.lit(2.4)))


def from_linear(c: Column) -> Column:
    return F.when(c <= LINEAR_SRGB_FROM, c * 12.92).otherwise(1.055 * F.power(c, F.lit(1 / 2.4)) - 0.055)


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", prefix: str = "lab_") -> DataFrame:
    """``df`` with <prefix>l, <prefix>a, <prefix>b of its sRGB columns (0 to 255)."""
    linear = [f"__lin{k}" for k in range(3)]
    xyz = [f"__xyz{k}" for k in range(3)]
    df = df.withColumns({name: to_linear(F.col(c) / F.lit(255.0)) for name, c in zip(linear, (r, g, b), strict=True)})
    df = df.withColumns({name: sum(F.col(c) * m for c, m in zip(linear, row, strict=True)) / white for name, row, white in zip(xyz, RGB_TO_XYZ, WHITE, strict=True)})
    df = df.withColumns({name: F.when(F.col(name) > EPSILON, F.cbrt(name)).otherwise((KAPPA * F.col(name) + 16) / 116) for name in xyz})
    x, y, z = map(F.col, xyz)
    return df.withColumns({f"{prefix}l": 116 * y - 16, f"{prefix}a": 500 * (x - y), f"{prefix}b": 200 * (y - z)}).drop(*linear, *xyz)


def with_rgb(df: DataFrame, prefix: str = "lab_", names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """The inverse of with_lab; channels are rounded but not clamped."""
    f = [f"__f{k}" for k in range(3)]
    linear = [f"__lin{k}" for k in range(3)]
    fy = (F.col(f"{prefix}l") + 16) / 116
    df = df.withColumns({f[0]: F.col(f"{prefix}a") / 500 + fy, f[1]: fy, f[2]: fy - F.col(f"{prefix}b") / 200})
    cube = lambda c: F.when(c > CUBE_FROM, c * c * c).otherwise((116 * c - 16) / KAPPA)
    y = F.when(F.col(f"{prefix}l") > L_CUBE_FROM, F.col(f[1]) * F.col(f[1]) * F.col(f[1])).otherwise(F.col(f"{prefix}l") / KAPPA)
    xyz = [cube(F.col(f[0])) * WHITE[0], y * WHITE[1], cube(F.col(f[2])) * WHITE[2]]
    df = df.withColumns({name: sum(c * m for c, m in zip(xyz, row, strict=True)) for name, row in zip(linear, XYZ_TO_RGB, strict=True)})
    return df.withColumns({name: half_up(from_linear(F.col(c)) * 255) for name, c in zip(names, linear, strict=True)}).drop(*f, *linear)


def with_delta_e(df: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], name: str = "delta_e") -> DataFrame:
    """``df`` with the CIEDE2000 difference of two Lab triples, in named stages so that each
    expression stays small and is computed once."""
    p = "__de_"
    c = lambda k: F.col(p + k)
    l1, a1, b1, l2, a2, b2 = map(F.col, (*one, *two))
    power7 = lambda x: F.power(x, F.lit(7.0))
    hue = lambda b, a: F.when((a == 0) & (b == 0), 0.0).otherwise(F.degrees(F.atan2(b, a)) + F.when(F.atan2(b, a) < 0, 360.0).otherwise(0.0))
    stages = [
        {"cb": (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2},
        {"g": 0.5 * (1 - F.sqrt(power7(c("cb")) / (power7(c("cb")) + 25.0**7)))},
        {"a1": a1 * (1 + c("g")), "a2": a2 * (1 + c("g"))},
        {"c1": F.sqrt(c("a1") * c("a1") + b1 * b1), "c2": F.sqrt(c("a2") * c("a2") + b2 * b2), "h1": hue(b1, c("a1")), "h2": hue(b2, c("a2"))},
        {"d": c("h2") - c("h1"), "s": c("h1") + c("h2"), "cc": c("c1") * c("c2"), "cm": (c("c1") + c("c2")) / 2, "lm": (l1 + l2) / 2},
        {
            "dh": F.when(c("cc") == 0, 0.0).when(F.abs(c("d")) <= 180, c("d")).when(c("d") > 180, c("d") - 360).otherwise(c("d") + 360),
            "hm": F.when(c("cc") == 0, c("s")).when(F.abs(c("d")) <= 180, c("s") / 2).when(c("s") < 360, (c("s") + 360) / 2).otherwise((c("s") - 360) / 2),
        },
        {
            "bh": 2 * F.sqrt(c("cc")) * F.sin(F.radians(c("dh") / 2)),
            "t": 1 - 0.17 * F.cos(F.radians(c("hm") - 30)) + 0.24 * F.cos(F.radians(2 * c("hm"))) + 0.32 * F.cos(F.radians(3 * c("hm") + 6)) - 0.20 * F.cos(F.radians(4 * c("hm") - 63)),
            "q": (c("lm") - 50) * (c("lm") - 50),
        },
        {
            "kl": (l2 - l1) / (1 + 0.015 * c("q") / F.sqrt(20 + c("q"))),
            "kc": (c("c2") - c("c1")) / (1 + 0.045 * c("cm")),
            "kh": c("bh") / (1 + 0.015 * c("cm") * c("t")),
            "rt": -2 * F.sqrt(power7(c("cm")) / (power7(c("cm")) + 25.0**7)) * F.sin(F.radians(60 * F.exp(-((c("hm") - 275) / 25) * ((c("hm") - 275) / 25)))),
        },
        {"de": F.sqrt(c("kl") * c("kl") + c("kc") * c("kc") + c("kh") * c("kh") + c("rt") * c("kc") * c("kh"))},
    ]
    for stage in stages:
        df = df.withColumns({p + k: v for k, v in stage.items()})
    return df.withColumnRenamed(p + "de", name).drop(*(p + k for stage in stages for k in stage if k != "de"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def grey(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Luma, with 255 where a pixel is transparent."""
    return F.when(a < 128, 255.0).otherwise(luma(r, g, b))


def text_color(r: Column, g: Column, b: Column) -> Column:
    return F.when(luma(r, g, b) > 128, "#000000").otherwise("#ffffff")


def adjust(c: Column, amount: int) -> Column:
    return clamp(c + amount)


def posterize_channel(v: Column, levels: int) -> Column:
    step = 255 / (max(2, levels) - 1)
    return half_up(half_up(v / step) * step)


def mask_channel(v: Column, mask: int) -> Column:
    return v.bitwiseAND(F.lit(mask))


def color_key(brand: Column, code: Column) -> Column:
    return F.when(code.isNotNull(), F.concat_ws(":", brand, code))


def color_label(brand: Column, code: Column, name: Column) -> Column:
    return F.concat_ws(" ", F.upper(brand), code, name)
