"""Operator 12: importance resampling of documents towards a target's distribution of words.

External sort-count: one pass over the texts writes each document's hashed n-grams as a packed
stream of uint16 buckets, many documents a row with the offsets at which each begins.  Counts
come from the streams: a block is sorted and run-length encoded, and tasks send one sum a
bucket.  The gains (a number a bucket, at most 65 536 of them, so their size is bounded) then
go to a second pass over the streams alone, which gathers them and adds them up for each
document with ``np.add.reduceat``.

A document's score is its weight plus Gumbel noise from a digest of its id, so that the highest
scores are a draw without replacement, the same in every run.  Ranks come from a range
partitioned sort, numbered within a task and shifted by the sizes of the tasks before; rows that
are alike are one row with a count there, so that copies don't meet in one task.

Defined results: a null text has no features and the weight 0; a null id draws as an empty one
and sorts behind all others of its score; rows that repeat take part each; texts of any length
are one stream; an empty table gives no rows, and an empty target counts as no features; further
columns, of any name, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, inputs, map_batches, materialise, text_or_empty

#: Features of a packed row, unless one document has more.
BLOCK = 1 << 17
#: Words whose bucket a worker remembers; the cache only saves time.
KNOWN_WORDS = 500_000

#: Bytes to bytes: A-Z in lower case, whatever is neither 0-9, a-z nor beyond ASCII as a space.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() and chr(c).islower() or chr(c).isdigit() else c + 32 if chr(c).isupper() else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    n_min: int = 1
    n_max: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10

    def __post_init__(self):
        if not (1 <= self.n_min <= self.n_max and 1 <= self.buckets <= 1 << 16 and 0 <= self.percent <= 100):
            raise ValueError("n-grams of one word at least, at most 65 536 buckets, a share of 0 to 100 %")


def words(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Hasher:
    """From words to the buckets of their n-grams."""

    def __init__(self, settings: Settings):
        self.settings, self.known = settings, {}

    def _bucket(self, gram: bytes) -> int:
        found = self.known.get(gram)
        if found is None:
            found = zlib.crc32(gram) % self.settings.buckets
            if len(gram) <= 64:
                if len(self.known) >= KNOWN_WORDS:
                    self.known = {}
                self.known[gram] = found
        return found

    def buckets(self, own: list[bytes]) -> np.ndarray:
        parts = []
        for n in range(self.settings.n_min, self.settings.n_max + 1):
            grams = own if n == 1 else list(map(b" ".join, zip(*(own[k:] for k in range(n)), strict=False)))
            parts.append(np.fromiter(map(self._bucket, grams), np.uint16, len(grams)))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


STREAM = "doc_ids array<bigint>, n_words array<bigint>, offsets array<bigint>, stream binary"


def _packed(ids: list, n_words: list[int], streams: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of STREAM of about BLOCK features each; offsets has an end more than documents."""
    first, held = 0, 0
    for k in range(len(ids) + 1):
        if k == len(ids) or held and held + len(streams[k]) > BLOCK:
            if k > first:
                offsets = np.cumsum([0, *map(len, streams[first:k])])
                yield ids[first:k], n_words[first:k], offsets.tolist(), np.concatenate(streams[first:k]).astype("<u2").tobytes()
            first, held = k, 0
        if k < len(ids):
            held += len(streams[k])


def streams(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed bucket streams of all documents (STREAM)."""

    def start():
        hasher = Hasher(settings)
        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("stream", pa.binary())])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            split = [words(t) for t in batch.column(1).to_pylist()]
            rows = list(_packed(batch.column(0).to_pylist(), list(map(len, split)), [hasher.buckets(w) for w in split]))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        return step

    bounded_batches(docs.sparkSession)
    slim = inputs(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    return map_batches(slim, start, STREAM)


def bucket_counts(packed: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, n) of the features of packed streams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                own = np.sort(np.frombuffer(raw.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.diff(own, prepend=-1 if len(own) == 0 else int(own[0]) - 1))
                counts[own[starts]] += np.diff(starts, append=len(own))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there])], names=["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, settings: Settings) -> list[int]:
    """Each bucket's gain, from (bucket, n) of the documents and of the target."""
    buckets = source.sparkSession.range(settings.buckets).select(F.col("id").cast("int").alias("bucket"))
    both = buckets.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0)
    n_s, n_t = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (source, target))
    real = lambda c, more: F.col(c).cast("double") + more
    ratio = real("t", 1.0) * (float(n_s) + settings.buckets) / (real("s", 1.0) * (float(n_t) + settings.buckets))
    return [r["gain"] for r in both.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]  # a row a bucket


def weights(packed: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document of packed streams."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def start():
        table = np.array(gain, np.int64)

        def one(row: dict) -> list[pa.Array]:
            offsets = np.array(row["offsets"])
            n = np.diff(offsets)
            gathered = np.append(table[np.frombuffer(row["stream"], "<u2")], 0)
            sums = np.where(n > 0, np.add.reduceat(gathered, offsets[:-1]), 0)  # reduceat gives an empty slice its first value
            return [pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_words"], pa.int64()), pa.array(n), pa.array(sums)]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [one(row) for row in batch.to_pylist()]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], schema=schema)

        return step

    return map_batches(packed, start, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` by falling score, with the count of those before: a range partitioned sort,
    whose tasks number their own rows, and then the sums of the tasks before.

    The numbers are written together with the rows, so they hold whatever is computed anew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            ends = before + np.cumsum(n)
            if len(n):
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], names=[*batch.schema.names, "part", "before"])

    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_words"), F.asc("n_features"), F.asc("weight")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    own = materialise(dealt.mapInArrow(run, f"{schema}, part int, before bigint"), "ranked")
    sums = own.groupBy("part").agg(F.sum("n").alias("size"))
    pairs = sorted((r["part"], r["size"]) for r in sums.collect())  # a row a task
    shifts = dict(zip((p for p, _ in pairs), np.cumsum([0, *(s for _, s in pairs)]).tolist(), strict=False))
    shift = own.sparkSession.createDataFrame(list(shifts.items()), "part int, shift bigint")
    return own.join(F.broadcast(shift), "part").withColumn("before", F.col("before") + F.col("shift")).drop("part", "shift")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` counts from 1
    over the drawn share of the documents that have words enough and is null for all others."""
    packed = materialise(streams(docs, settings, id_col, text_col), "streams")
    wanted = streams(target, settings, target_id, target_text)
    gain = gains(bucket_counts(packed, settings), bucket_counts(wanted, settings), settings)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    alike = weights(packed, gain).groupBy("doc_id", "n_words", "n_features", "weight").agg(F.count("*").alias("n")).withColumn("score", F.col("weight") + noise)
    alike = materialise(alike, "scored")
    enough = F.col("n_words") >= settings.least_words
    drawn = alike.where(enough).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * settings.percent // 100
    each = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")
    ranked = _numbered(alike.where(enough)).select("doc_id", "n_features", "weight", "score", "before", each)
    ranked = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("before") + F.col("k") <= drawn, F.col("before") + F.col("k")).alias("rank"))
    others = alike.where(~enough).select("doc_id", "n_features", "weight", "score", each).drop("k")
    return ranked.unionByName(others.withColumn("rank", F.lit(None).cast("long")))
