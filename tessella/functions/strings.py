"""Small text functions: sizes and ratios, escapes, digests, nested JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The aspect ratios offered, in order of preference.
RATIOS = ("21:9", "16:9", "3:2", "4:3", "1:1", "3:4", "2:3", "9:16")

#: Output sizes by resolution, in the order of RATIOS.
DIMENSIONS = {
    "1k": ("2016x846", "1664x936", "1584x1056", "1472x1104", "1328x1328", "1104x1472", "1056x1584", "936x1664"),
    "2k": ("3024x1296", "2560x1440", "2496x1664", "2304x1728", "2048x2048", "1728x2304", "1664x2496", "1440x2560"),
    "4k": ("6197x2656", "5404x3040", "4992x3328", "4693x3520", "4096x4096", "3520x4693", "3328x4992", "3040x5404"),
}

_SIZE = r"(?i)^(\d{2,5})x(\d{2,5})$"


def as_string(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def as_number(text: Column) -> Column:
    """A finite number, else null."""
    value = text.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def parse_size(text: Column) -> tuple[Column, Column]:
    """(width, height) of 'WxH', nulls for anything else."""
    trimmed = F.trim(text)
    return tuple(F.when(trimmed.rlike(_SIZE), F.regexp_extract(trimmed, _SIZE, k)).cast("int") for k in (1, 2))


def resolution(width: Column, height: Column) -> Column:
    side = F.greatest(width, height)
    return F.when(side >= 3500, "4k").when(side >= 1800, "2k").when(side.isNotNull(), "1k").otherwise("2k")


def nearest_ratio(width: Column, height: Column) -> Column:
    """The offered ratio closest to width / height, the first of equals; 1:1 without a size."""
    offered = [F.struct(F.abs(width / height - F.lit(int(r.split(":")[0]) / int(r.split(":")[1]))).alias("far"), F.lit(k).alias("k"), F.lit(r).alias("ratio")) for k, r in enumerate(RATIOS)]
    return F.when(width.isNull() | height.isNull(), "1:1").otherwise(F.array_min(F.array(*offered))["ratio"])


def escape_xml(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def gradient_id(brand: Column, code: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("bead-"), brand, F.lit("-"), code), "[^a-zA-Z0-9_-]", "-")


def crc32_hex(text: Column) -> Column:
    return F.lower(F.hex(F.crc32(text.cast("binary"))))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def md5_hex(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def hmac_sha256_hex(key: Column, message: Column) -> Column:
    """The keyed digest of RFC 2104, of built-in functions only: the key, hashed if it is longer
    than a block of 64 bytes, is padded to a block and mixed with two constants."""
    raw = key.cast("binary")
    short = F.when(F.octet_length(raw) > 64, F.sha2(raw, 256)).otherwise(F.hex(raw))
    block = F.rpad(short, 128, "0")

    def mixed(constant: int) -> Column:
        byte = lambda k: F.conv(F.substring(block, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.lpad(F.hex(byte(k).bitwiseXOR(F.lit(constant))), 2, "0")), "")

    inner = F.sha2(F.unhex(F.concat(mixed(0x36), F.hex(message.cast("binary")))), 256)
    return F.sha2(F.unhex(F.concat(mixed(0x5C), inner)), 256)


def uuid(hyphens: bool = True) -> Column:
    """A random UUID for each row; another one whenever the plan runs again."""
    return F.uuid() if hyphens else F.replace(F.uuid(), F.lit("-"), F.lit(""))


def random_large_id() -> Column:
    """A random number of 19 digits from 7 * 10**18 on, below 8 * 10**18 - 1, as text."""
    return (F.floor(F.rand() * F.lit(999_999_999_999_999_999.0)).cast("decimal(38,0)") + F.lit("7000000000000000000").cast("decimal(38,0)")).cast("string")


def json_path(text: Column, path: str) -> Column:
    """A value inside a JSON text, null where any step is missing: '$.a[0].b'."""
    return F.get_json_object(text, path)


def data_url_bytes(text: Column, most: int = 100 * 1024 * 1024) -> Column:
    """The bytes of a base64 data URL; malformed ones and larger ones than ``most`` fail."""
    body = F.regexp_extract(text, r"^data:[^;,]+;base64,([A-Za-z0-9+/=\s]+)$", 1)
    raw = F.unbase64(body)
    return F.when(F.length(body) == 0, F.raise_error(F.lit("not a data URL"))).when(F.octet_length(raw) > most, F.raise_error(F.lit("data URL is too large"))).otherwise(raw)


def data_url(raw: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(raw))


def known_ratio(ratio: Column) -> Column:
    return F.when(ratio.isin(*RATIOS), ratio).otherwise("1:1")


def dimensions(resolution_: Column, ratio: Column) -> Column:
    """The output size 'WxH' of a resolution and an offered ratio."""
    place = F.array_position(F.array(*map(F.lit, RATIOS)), known_ratio(ratio)).cast("int")
    tables = {k: F.array(*map(F.lit, v)) for k, v in DIMENSIONS.items()}
    return F.when(resolution_ == "4k", F.element_at(tables["4k"], place)).when(resolution_ == "2k", F.element_at(tables["2k"], place)).otherwise(F.element_at(tables["1k"], place))


def is_image_input(text: Column) -> Column:
    """Whether a text is a base64 image data URL or a web address."""
    return text.rlike(r"(?i)^data:image/[a-z0-9.+-]+;base64,") | text.rlike(r"(?i)^https?://")


def image_format(text: Column) -> Column:
    kind = F.lower(as_string(text))
    return F.when(kind.isin("png", "webp"), kind).otherwise("jpeg")


def query_string(parameters: Column) -> Column:
    """A map of texts as an encoded query string, in the map's order."""
    return F.array_join(F.transform(F.map_entries(parameters), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def error_message(text: Column) -> Column:
    """The message of a JSON error body: at its top, else in its first entry."""
    return F.coalesce(as_string(F.get_json_object(text, "$.error.message")), as_string(F.get_json_object(text, "$.data[0].error.message")))


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))
