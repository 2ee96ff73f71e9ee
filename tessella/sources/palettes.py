"""Palette tables: JSON and CSV files, brand lookup and fallback, upsert.

A palette row is (brand, code, name, ord, r, g, b, lab_l, lab_a, lab_b).  ``ord`` is the place
in the file and breaks all ties, since a DataFrame has no order of its own.
"""

from __future__ import annotations

import urllib.parse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions import color
from tessella.operators.lineage import shared_folder

CARD_SCHEMA = "code string, name string, rgbHex string, source string, isApproximate boolean"


def read_json_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a folder of JSON arrays, one file a brand (named after it), in file order."""
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    cards = F.from_json(F.decode("content", "UTF-8"), f"array<struct<{', '.join(c.replace(' ', ':') for c in CARD_SCHEMA.split(', '))}>>")
    brand = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    rows = whole.select(brand.alias("brand"), F.posexplode(cards).alias("ord", "card"))
    return rows.select("brand", "card.code", "card.name", "card.rgbHex", "card.source", F.coalesce("card.isApproximate", F.lit(False)).alias("isApproximate"), "ord")


def numbered(cards: DataFrame) -> DataFrame:
    """Cards with sequential ids over brands in order, as one exported list has them.  The
    running number needs the sizes of earlier brands only, not one task with all cards."""
    sizes = cards.groupBy("brand").agg(F.count("*").alias("n"))
    before = sizes.select("brand", (F.sum("n").over(Window.orderBy("brand")) - F.col("n")).alias("before"))  # one row a brand
    return cards.join(before, "brand").withColumn("id", (F.col("before") + F.col("ord") + 1).cast("int")).drop("before")


def read_csv_cards(spark: SparkSession, path: str, source: str, brand: str) -> DataFrame:
    """Cards of a CSV file without header: code, name, r, g, b."""
    rows = spark.read.schema("code string, name string, r int, g int, b int").csv(path, header=False, quote="")
    return rows.select(F.lit(brand).alias("brand"), "code", "name", F.upper(color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))).alias("rgbHex"), F.lit(source).alias("source"), F.lit(False).alias("isApproximate"))


def with_channels(cards: DataFrame) -> DataFrame:
    """Cards with r, g, b and Lab columns."""
    r, g, b = color.hex_to_rgb(F.col("rgbHex"))
    return color.with_lab(cards.withColumns({"r": r, "g": g, "b": b}))


def from_cards(cards: DataFrame) -> DataFrame:
    """Palette rows of stored cards, whose Lab columns are taken as they are."""
    r, g, b = color.hex_to_rgb(F.col("rgbHex"))
    return cards.select("brand", "code", "name", "ord", r.alias("r"), g.alias("g"), b.alias("b"), F.col("labL").alias("lab_l"), F.col("labA").alias("lab_a"), F.col("labB").alias("lab_b"))


def of_brand(cards: DataFrame, brand: str | None) -> DataFrame:
    """The cards of one brand by code; no brand is an error, an unknown one gives no rows."""
    if not brand:
        raise ValueError("a brand is required")
    return cards.where(F.col("brand") == brand).orderBy("code")


def of_brand_or_first(cards: DataFrame, brand: str) -> DataFrame:
    """The cards of a brand or, if there are none, of the first card's brand."""
    found = cards.agg(F.coalesce(F.max(F.when(F.col("brand") == brand, F.col("brand"))), F.min_by("brand", "ord")).alias("chosen"))
    return cards.join(F.broadcast(found), F.col("brand") == F.col("chosen")).drop("chosen")  # one row


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cards by (brand, code), new ones over old ones; the last of repeated new ones (by
    ``ord``) wins."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    last = Window.partitionBy("brand", "code").orderBy(F.desc("__age"), F.desc("ord"))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__age")


def upsert_table(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Upsert cards into a table at ``path``, one folder a brand, and return the whole table.

    Only brands of which a card is new or differs are written, by a dynamic overwrite of their
    folders; all other files stay as they are.  A card carries the ``version`` of the upsert that
    wrote its brand last.  Cards are compared without their ``ord``, unless they change besides.

    A run that was broken off is simply run again: brands that it had replaced don't differ any
    more, the others are still as they were.  What is to be written lies in the shared folder
    before, since a plan can't overwrite what it reads."""
    fields = [f for f in new.schema.fields if f.name != "version"]
    cards, schema = [f.name for f in fields], StructType(fields).add("version", "long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(path) if files.exists(folder) else spark.createDataFrame([], schema)

    old, latest = stored(), upsert(new.select(*cards).limit(0), new.select(*cards))
    version = (old.agg(F.max("version")).first()[0] or 0) + 1
    compared = [c for c in cards if c not in ("brand", "code", "ord")]
    before = old.select("brand", "code", *(F.col(c).alias(f"old_{c}") for c in compared), F.lit(True).alias("known"))
    differs = F.col("known").isNull()
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    changed = latest.join(before, ["brand", "code"], "left").where(differs).select(*cards)
    merged = upsert(old.select(*cards), changed).join(changed.select("brand").distinct(), "brand", "left_semi")
    staged = shared_folder(spark, "cards")
    merged.withColumn("version", F.lit(version).cast("long")).write.parquet(staged)
    ready = spark.read.schema(schema).parquet(staged)
    if ready.limit(1).count():
        ready.repartition("brand").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("brand").parquet(path)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
    return stored()


def write_json_array(cards: DataFrame, path: str, order: str = "id", parts: int = 8) -> None:
    """Cards as one JSON array over many text files: read one after the other in the order of
    their names they are one document, its objects in the order of the unique column ``order``.

    Rows are dealt by ranges of ``order`` and sorted within a file; Spark's committer moves the
    files, and nothing goes through the driver but the first and last place."""
    first, last = cards.agg(F.min(order), F.max(order)).first()
    if first is None:
        cards.sparkSession.range(1).select(F.lit("[]").alias("value")).write.mode("overwrite").text(path)
        return
    object_ = F.to_json(F.struct(*cards.columns), {"ignoreNullFields": "false"})
    at = F.col(order)
    line = F.concat(F.when(at == F.lit(first), "[").otherwise(" "), object_, F.when(at == F.lit(last), "]").otherwise(","))
    cards.repartitionByRange(parts, order).sortWithinPartitions(order).select(line.alias("value")).write.mode("overwrite").text(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cards that ``write_json_array`` wrote, a line an object."""
    bare = F.regexp_replace("value", r"^[\[ ]|[\],]$", "")
    return spark.read.text(path).select(F.from_json(bare, schema).alias("card")).where("card is not null").select("card.*")


def write_brand_files(cards: DataFrame, path: str) -> None:
    """Cards as the files that ``read_json_cards`` reads: one JSON array a brand in the order of
    ``ord``, named after it.  A palette file is one document, so a brand's cards are one row."""
    object_ = F.to_json(F.struct("code", "name", "rgbHex", "source", "isApproximate"), {"ignoreNullFields": "false"})
    texts = cards.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("ord", object_.alias("card")))).alias("cards"))
    text = F.concat(F.lit("["), F.array_join(F.transform("cards", lambda c: c["card"]), ",\n"), F.lit("]"))
    texts.select("brand", text.alias("value")).repartition("brand").write.mode("overwrite").partitionBy("brand").option("lineSep", "\n").text(path)
    spark = cards.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(top):  # a brand each; only names change
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith("brand="):
            brand = urllib.parse.unquote(name.removeprefix("brand="))
            for part in files.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    files.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(top, f"{brand}.json"))
            files.delete(folder.getPath(), True)


def write_json(cards: DataFrame, path: str, by_brand: bool = False) -> None:
    """JSON lines, in one folder a brand if asked for."""
    writer = cards.write.mode("overwrite")
    (writer.partitionBy("brand") if by_brand else writer).json(path)
