"""Operator 13: URL filters by rules of hosts and path prefixes, in Spark's own functions.

Each URL is expanded into expressions, a suffix of its host's labels with a prefix of its path;
an expression's SHA-256 is looked up by its first ``PREFIX`` hex digits in an equi-join with the
rules and confirmed by the whole digest (Catalyst makes that one join on both).  Of the rules that fit, the longest (host and path
together, then the longer host, then block before allow) gives the verdict.

Only the shapes (labels of the host, characters of the path) that some rule has are expanded:
all others can't fit a rule.  Shapes come to the driver; there are as many as rules at most and,
as hosts have few labels and paths few lengths, far fewer in a long list.

Fitting rules are reduced to one a (host, path) before they are joined back, on a further key,
so that a URL or host that many rows have is split by adaptive execution.

Defined results: a null URL or one without ``://`` has an empty host and path and fits what the
empty host fits; rows that repeat, and ids that are null or repeat, give a row each; further
columns, of any name, are not read; rules with a null host, path or verdict are left out, and of
rules of one host and path block wins; without rules, or where none fits, ``rule`` is null and
the verdict ``default``; an empty table gives no rows.  Very long URLs give no more expressions
than there are shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import inputs, text_or_empty

#: Hex digits of the digests' prefixes: 2**32 of them.
PREFIX = 8
#: Larger tables of rules aren't broadcast but joined by a shuffle.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): from behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; from
    there up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lowered(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from a few (host, path, verdict)."""
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule, strict=True))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _suffix(host: Column, labels: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -labels)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    """Of an expression; a host holds no slash and a path begins with one or is empty."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _keyed(rules: DataFrame) -> DataFrame:
    own = inputs(rules, host="host", path="path", verdict="verdict").where("host is not null and path is not null and verdict is not null")
    own = own.select(lowered(F.col("host")).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict")).getField("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return own.select("host", "path", "verdict", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX).alias("prefix"))


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct urls (host, path) that a rule fits."""
    keyed = _keyed(rules)
    shapes = [F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["chars"]).alias("chars")) for r in keyed.select(_labels(F.col("host")).alias("labels"), F.length("path").alias("chars")).distinct().collect()]
    if keyed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    own = F.filter(F.array(*shapes), lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["chars"] <= F.length("path"))) if shapes else F.array().cast("array<struct<labels:int,chars:int>>")
    asked = urls.select("host", "path", F.explode(own).alias("s"))
    digest = _digest(_suffix(F.col("host"), F.col("s.labels")), F.substring(F.col("path"), F.lit(1), F.col("s.chars")))
    asked = asked.select("host", "path", digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("prefix"))
    found = asked.join(keyed.withColumnsRenamed({"host": "rule_host", "path": "rule_path"}), "prefix").where("digest = rule_digest")
    order = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.col("verdict") == "block", "rule_host", "rule_path", "verdict")
    best = found.groupBy("host", "path").agg(F.max(order).alias("best"))
    return best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    host, path = split_url(text_or_empty(F.col("url")))
    rows = inputs(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    key = F.xxhash64("host", "path").alias("key")  # another key than the groups', so that both sides are dealt anew and hot ones split
    best = fitting(rows, rules).select(key, F.col("host"), F.col("path"), "rule", "verdict")
    found = rows.select("*", key).join(best, ["key", "host", "path"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
