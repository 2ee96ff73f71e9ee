"""Operator 2: removal of repeated passages, by content-defined chunking.

A gear rolling hash over the UTF-8 bytes puts a chunk's end wherever the hash of the last 16
bytes has its high bits zero, so that chunks behind an insertion come out as before.  A chunk
is named by 96 bits of its digest.  Its first occurrence, by document id and place, stays;
every later one is a repeat.  Runs of adjacent repeats of at least ``min_bytes`` are removed.

Defined results: a null text counts as empty and stays null in the filtered table; texts
shorter than the smallest chunk are one chunk; rows of the same id, or of none, and the same
text are one document, while other texts of that id are documents of their own; a null id
sorts behind all others, so its repeats go first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrays import bound
from tessella.llm.common import bounded_batches, inputs, map_batches, materialise, text_or_empty

#: Smallest and largest chunk in bytes; an end is found every 2**MASK_BITS bytes on average.
LEAST, MOST, MASK_BITS = 16, 256, 5
#: Shortest run of repeated chunks that is removed: about ten words.
MIN_BYTES = 64

GEAR = np.random.default_rng(64_023).integers(0, 2**16, 256, dtype=np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at every byte: h = 2 h + GEAR[byte], by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)  # the right side is computed before it is added
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends (exclusive) of the chunks of UTF-8 bytes; no chunk splits a character."""
    n = len(data)
    if n == 0:
        return []
    begins = np.ones(n + 1, bool)  # a character begins here
    begins[:n] = (data & 0xC0) != 0x80
    mask = np.uint16(((1 << MASK_BITS) - 1) << (16 - MASK_BITS))
    ends = (np.flatnonzero((gear_hashes(data) & mask) == 0) + 1).tolist()
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > MOST:
            last += MOST
            while not begins[last]:
                last -= 1
            out.append(last)
        if end - last >= LEAST and (end == n or begins[end]) or end == n and end > last:
            out.append(end)
            last = end
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    slim = inputs(docs, doc_id=id_col, text=text_col)
    text = text_or_empty(F.col("text"))
    return slim.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def chunks(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, h1, h2) of every chunk; offsets in bytes."""

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, starts, ends, digests = [], [], [], []
            digest = xxhash.xxh3_128_digest
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                own = chunk_ends(np.frombuffer(raw, np.uint8))
                if own:
                    row.append(np.full(len(own), k))
                    first = [0, *own[:-1]]
                    starts += first
                    ends += own
                    digests += [digest(raw[a:b]) for a, b in zip(first, own, strict=True)]
            if not digests:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2 + [pa.array([], pa.int32())] * 2 + [pa.array([], pa.int64()), pa.array([], pa.int32())], names)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(np.concatenate(row))
            arrays = [batch.column(0).take(at), batch.column(2).take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(h[:, 0].copy()), pa.array((h[:, 1] >> 32).astype(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names)

        return step

    names = ["doc_id", "text_key", "start", "end", "h1", "h2"]
    return map_batches(texts, start, "doc_id long, text_key long, start int, end int, h1 long, h2 int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, text_key and the spans to remove: start, end (bytes) and the document that
    keeps the first occurrence of the span's first chunk."""
    found = materialise(chunks(_texts(docs, id_col, text_col)), "chunks")
    # the text tells documents apart only where texts share an id: that is looked up first,
    # as its key would travel with every chunk
    own = found.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"))
    shared = own.where("a <> b").limit(1).count()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *["text_key"] * shared, "start")
    firsts = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = found.join(firsts, ["h1", "h2"]).where(place != F.col("first"))
    lists = later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("first.doc_id").alias("first_doc_id")))).alias("repeated"))
    spans = F.filter(_runs(F.col("repeated")), lambda r: r["end"] - r["start"] >= min_bytes)
    return lists.select("doc_id", "text_key", spans.alias("spans")).where(F.size("spans") > 0)


def _runs(chunks: Column) -> Column:
    """Sorted chunks (start, end, first_doc_id), of which adjacent ones become runs: a run is
    known by the chunk that has no neighbour before it and ends where the chunk before the
    next run does."""

    def closed(own: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(own, k - 1)["end"])
        heads = F.transform(own, lambda x, k: F.when((k == 0) | (before(k) != x["start"]), F.struct(x["start"].alias("start"), x["first_doc_id"].alias("first_doc_id"), before(k).alias("before"))))
        last = F.element_at(own, -1)["end"]
        ended = bound(F.filter(heads, lambda h: h.isNotNull()), lambda h: F.transform(h, lambda x, k: F.struct(x["start"].alias("start"), F.coalesce(F.get(h, k + 1)["before"], last).alias("end"), x["first_doc_id"].alias("first_doc_id"))))
        return ended

    return bound(chunks, closed)


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, cut in zip(texts, spans, strict=True):
        if text is not None and cut is not None and len(cut):
            raw, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
            for span in cut:
                parts.append(raw[at : span["start"]])
                at = span["end"]
            text = b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
        out.append(text)
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, spans_col: str | None = None) -> DataFrame:
    """``docs`` with every repeated passage cut out of its text; with ``spans_col``, also what
    was cut: array of (start, end, first_doc_id), null where nothing was."""
    own, key, spans = "__tessella_id", "__tessella_key", "__tessella_spans"
    cut = repeats(docs, id_col, text_col, min_bytes).select(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), F.col("spans").alias(spans))
    rows = docs.withColumns({own: docs[id_col].cast("long"), key: F.xxhash64(text_or_empty(docs[text_col]))})
    without = F.pandas_udf(_without, "string")
    joined = rows.join(cut, (F.col(key) == F.col("cut_key")) & F.col(own).eqNullSafe(F.col("cut_id")), "left")
    columns = [F.when(F.col(spans).isNull(), F.col(f"`{c}`").cast("string")).otherwise(without(F.col(f"`{c}`").cast("string"), F.col(spans))).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([F.col(spans).alias(spans_col)] if spans_col else []))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, the text that stays, the spans cut and their number of bytes."""
    slim = inputs(docs, doc_id=id_col, text=text_col)
    out = remove_repeats(slim, min_bytes=min_bytes, spans_col="spans")
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]), F.lit(0))
    return out.select("doc_id", "text", F.coalesce(F.size("spans"), F.lit(0)).alias("n_removed"), removed.cast("long").alias("bytes_removed"), "spans")
