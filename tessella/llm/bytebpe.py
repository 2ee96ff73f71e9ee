"""Operator 7: byte-level BPE encoding and decoding by a file of ranks.

Text is cut into words by the usual pattern; each distinct word's bytes are folded by ranked
merges - of all neighbouring pieces the pair whose union has the lowest rank becomes one, the
leftmost of equal ones first - until no union has a rank.  Decoding concatenates the pieces.

Two forms.  ``merged`` is the fold as Spark higher-order functions over arrays of binary, with
the ranks as a literal map (in buckets, since a map is searched from its start): it suits a
column of distinct words, and the tests hold it against the other form.  ``encode`` is for
whole corpora: it keeps each task's distinct words with their ids in a bounded cache, because
bringing the ids of distinct words back to their places by a join would shuffle a row for
every word of the corpus (see the README for figures).

Defined results: a null or empty text has no ids and decodes to nothing; the text <|endoftext|>
is ordinary text; ids repeat and are null as in the table; an empty table gives no rows.  Very
long words (texts without spaces) are folded by a heap, in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.chunks import ChunkCache
from tessella.llm.common import bounded_batches, inputs, kept, map_batches, text_or_empty

#: Entries of the literal rank map that share a bucket, about.
BUCKET = 8


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Ranks:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def fold(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        parts = [word[k : k + 1] for k in range(len(word))]
        if len(parts) > 200:
            return self._fold_long(parts)
        unions = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
        while unions and (low := min(unions)) < 1 << 30:
            k = unions.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del unions[k]
            if k < len(unions):
                unions[k] = ranks.get(parts[k] + parts[k + 1], 1 << 30)
            if k:
                unions[k - 1] = ranks.get(parts[k - 1] + parts[k], 1 << 30)
        return [ranks[p] for p in parts]

    def _fold_long(self, parts: list[bytes]) -> list[int]:
        """The same fold with a heap and linked neighbours, for very long words."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[k], parts[j] = a + b, b""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
            if (i := before[k]) >= 0 and (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        return [ranks[p] for p in parts if p]


def cache_of(path: str, pattern: str) -> tuple[ChunkCache, Ranks]:
    """Chunks to (little-endian ids, their decimals each with a comma behind)."""
    caches: dict[tuple[str, str], tuple[ChunkCache, Ranks]] = kept(__name__)
    if (path, pattern) not in caches:
        table = Ranks(read_ranks(path))
        words = regex.compile(pattern).findall

        def encode(chunks: list[str]) -> Iterator[bytes]:
            for chunk in chunks:
                ids: list[int] = []
                for word in words(chunk):
                    ids += table.fold(word.encode("utf-8", "surrogatepass"))
                yield np.array(ids, "<u4").tobytes()

        caches[path, pattern] = ChunkCache(encode), table
    return caches[path, pattern]


_run_with_space = regex.compile(r"\s ").search
_before_spaces = regex.compile(r"(?<=\S)(?= )", regex.V1).split


def chunks_of(text: str) -> list[str]:
    """Parts of a text that the pattern never looks across: spaces behind anything but white
    space begin a part, since a word takes spaces only before it.  How a run of white space is
    cut depends on what follows it, so a run stays in one part."""
    if _run_with_space(text):
        return _before_spaces(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every text."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, "ids array<int>", lambda ids, _: [np.frombuffer(x, "<i4") for x in ids], [pa.list_(pa.int32())])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""

    def digests(ids: list[bytes], table: Ranks) -> Iterator[list]:
        piece = table.pieces.__getitem__
        n, names, decoded = [], [], []
        for raw in ids:
            own = np.frombuffer(raw, "<u4").tolist()
            n.append(len(own))
            names.append(hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(piece, own))).hexdigest())
        return n, names, decoded

    return _encoded(docs, ranks_path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, [pa.int64(), pa.string(), pa.string()])


def _encoded(docs, ranks_path, pattern, id_col, text_col, columns, make, kinds) -> DataFrame:
    bounded_batches(docs.sparkSession)
    slim = inputs(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text"))
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def start():
        cache, table = cache_of(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = cache.values([chunks_of(t) for t in batch.column(1).to_pylist()])
            made = make([b"".join(v) for v in values], table)
            made = made if len(kinds) > 1 else [made]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], names)

        return step

    return map_batches(slim, start, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {columns}")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """``encoded`` with the concatenated pieces of its ids; an unknown id fails the task."""
    by_id = sorted((rank, piece) for piece, rank in read_ranks(ranks_path).items())
    sent = encoded.sparkSession.sparkContext.broadcast(Ranks({p: r for r, p in by_id}).pieces)

    @F.pandas_udf("binary")
    def joined(ids):
        import pandas as pd

        return pd.Series([None if x is None else b"".join(sent.value[i] for i in x) for x in ids], dtype=object)

    bounded_batches(encoded.sparkSession)
    return encoded.withColumn(bytes_col, joined(F.col(ids_col)))


def rank_literal(ranks: dict[bytes, int]) -> tuple[Column, int]:
    """The ranks as one literal: an array of small maps from hexadecimal pieces to ranks, and
    how many maps it has.  A piece is in the map of its crc32."""
    import zlib

    n = max(1, len(ranks) // BUCKET)
    buckets: list[dict[str, int]] = [{} for _ in range(n)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % n][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>"), n


def merged(word: Column, ranks: dict[bytes, int]) -> Column:
    """The fold as higher-order functions: the ids of a binary column of single words."""
    table, n = rank_literal(ranks)
    none = 1 << 30

    def rank(piece: Column) -> Column:
        own = F.element_at(table, (F.crc32(piece) % n + 1).cast("int"))
        return F.coalesce(F.try_element_at(own, F.hex(piece)), F.lit(none))

    def merge(parts: Column, _: Column) -> Column:
        pairs = F.zip_with(parts, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), rank(F.concat(a, b))).otherwise(none))
        low = F.array_min(F.transform(pairs, lambda r, k: F.struct(r.alias("rank"), k.alias("at"))))
        at = low["at"] + 1
        two = F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)))
        done = F.concat(F.slice(parts, F.lit(1), at - 1), two, F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))))
        return F.when(low["rank"] < none, done).otherwise(parts)

    size = F.octet_length(word)
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: F.substring(word, k, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), bytes_, merge)
    return F.when(size == 0, F.expr("cast(array() as array<int>)")).otherwise(F.transform(folded, rank))
