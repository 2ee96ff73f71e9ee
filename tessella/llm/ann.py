"""Operator 8: approximate nearest neighbours by cross-polytope hashing.

Vectors are turned into unit vectors, and each of ``tables`` hashes sends them through fast
pseudo-rotations (random signs and a Hadamard transform, three times) to the nearest of the
signed axes.  A bucket is one axis or, as rows grow, a concatenation of the axes of several
rotations, the last one among part of its axes only: so many buckets that one holds about
``BUCKET_ROWS`` rows at any size.  Every vector is in one bucket of each table; a query probes
the buckets whose axes lie nearest to it, a share of them that falls as rows grow
(``probes_for``), and all candidates found there are ranked by their exact inner products.
Queries that find fewer than they may are compared with all candidates.

To rank by inner product among vectors of any length, candidates get one further component
that makes all of them equally long; queries get 0 there.  So that a few long vectors don't
drown the others' directions, candidates are indexed apart by ranges of norm (a factor of the
root of 2 wide), each as long as the longest of its range, with as many buckets and probes as
its own rows call for.  Ranges of hardly any rows are one bucket together, which every query
is compared with.

Equal vectors collapse first: of each vector the k + 1 smallest ids are candidates, which is
all that any query can need, and a query vector is searched once for all of its ids.  Probes
are rows of a query's key, a group of adjacent buckets and a mask of those that it probes
there; its vector joins them once a group.  Groups and the queries that probe them meet in
blocks of bounded size, so that a bucket with any share of the vectors is worked on by many
tasks; a block hands on the nearest of each of its queries only, and a last merge takes the
nearest of those.  What is sent at a time is bounded: tables, and where that isn't enough
parts of the queries too, are searched in rounds (``rounds_for``), so that the disk needed
grows with the vectors, whatever the number of probes.

Defined results: vectors that are null, zero, of another length than most (the longest length
held by the greatest number of rows), or hold null or non-finite components take no part; an
id held by several rows counts once, as query and as candidate, by the best product of any of
its rows, and a query's own id is left out; ties go to the smaller id; fewer candidates than
k: all of them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, discard, inputs, join_hot, materialise

K = 20
TABLES = 16
#: Rows that a bucket holds about; buckets probed of 2 000 rows, and the power of the rows by
#: which that share falls.  Fitted on vectors without structure, the hardest case.
BUCKET_ROWS, PROBED, FALL = 256, 0.05, 0.35
#: Ranges of norm of no more rows are one bucket together, whose number as a range is this.
FEW_ROWS, FEW = 512, -1
#: Axes of a rotation that a query combines with those of the others, and the most sums that
#: are ranked at a time.
NEAR_AXES, SUMS = 48, 4_000_000
#: Bits of a bucket's number that tell the buckets of a group apart.
GROUP_BITS = 3
#: Vectors and queries in a block, about; so many places that are cut may be broadcast.
BLOCK, QUERY_BLOCK, CUT_PLACES = 4_096, 2_048, 100_000
#: A round sends about so many bytes of vectors, or so many times those of the candidates.
ROUND_BYTES, ROUND_SHARE = 4 << 30, 4
SEED = 8_128
#: Columns that name a vector (128 bits of hash) and a group of buckets.
KEY, PLACE = ("h1", "h2"), ("band", "tab", "grp")


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (length a power of two), normed."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Every row under one pseudo-rotation (three rows of signs)."""
    for flip in flips:
        x = hadamard(x * flip)
    return x


def padded_size(n: int) -> int:
    return 1 << max(1, (n - 1).bit_length())


def probes_for(rows: int, buckets: int) -> int:
    """Buckets of a table that a query probes among ``rows`` candidates."""
    return min(buckets, max(1, math.ceil(buckets * PROBED * (2_000 / max(1, rows)) ** FALL)))


class Hash:
    """Bucket numbers in every table, alike on every worker."""

    def __init__(self, size: int, rows: int, tables: int):
        self.padded, self.tables = padded_size(size + 1), tables
        whole = (2 * self.padded).bit_length() - 1  # bits of one rotation's signed axes
        bits = max(whole, round(math.log2(max(1, rows) / BUCKET_ROWS)))
        self.axes = [2 * self.padded] * (bits // whole) + ([1 << bits % whole] if bits % whole else [])
        self.buckets, self.low_bits = 1 << bits, min(GROUP_BITS, bits - whole)
        self.flips = np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, len(self.axes), 3, self.padded))

    def _sides(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """For each rotation how near every row lies to its signed axes."""
        out = []
        for n, flips in zip(self.axes, self.flips[table], strict=True):
            own = rotate(unit, flips)[:, : n // 2]
            out.append(np.concatenate((own, -own), axis=1))
        return out

    def buckets_of(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables."""
        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            for n, side in zip(self.axes, self._sides(unit, t), strict=True):
                out[:, t] = out[:, t] * n + side.argmax(axis=1)
        return out

    def probes(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """rows x probes: the buckets of a table with the greatest sums over the rotations."""
        out = np.empty((len(unit), probes), np.int64)
        keep = [n if probes >= self.buckets else min(n, max(NEAR_AXES, probes)) for n in self.axes]
        step = max(1, SUMS // (probes * max(keep)))
        for at in range(0, len(unit), step):
            rows = unit[at : at + step]
            code, total = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1))
            for n, most, side in zip(self.axes, keep, self._sides(rows, table), strict=True):
                axis = np.argsort(-side, axis=1, kind="stable")[:, :most]
                near = np.take_along_axis(side, axis, axis=1)
                code = (code[:, :, None] * n + axis[:, None, :]).reshape(len(rows), -1)
                total = (total[:, :, None] + near[:, None, :]).reshape(len(rows), -1)
                best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
                code, total = np.take_along_axis(code, best, axis=1), np.take_along_axis(total, best, axis=1)
            out[at : at + step] = code
        return out


class Range(NamedTuple):
    """Candidates of about one norm: the longest's, the hash for their number, their probes."""

    longest: float
    hashed: Hash
    probes: int


def rounds_for(rows: int, queries: int, probes: int, tables: int, vector_bytes: int) -> tuple[int, int]:
    """(tables, parts of the queries) that are searched at a time, where a query probes
    ``probes`` buckets of a table: what a round sends stays about within its bound."""
    bound = max(ROUND_BYTES, ROUND_SHARE * rows * vector_bytes)
    at_once = max(1, min(tables, bound // max(1, (rows + queries * probes) * vector_bytes)))
    return at_once, max(1, -(-queries * probes * vector_bytes // bound))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, log_norm (to base 2) and KEY of the rows that take part.  Floats stay
    floats on their way through shuffles; all arithmetic is in double precision, lengths apart
    from their largest component, so that no square over- or underflows."""
    kind = vectors.schema["vector"].dataType.elementType.simpleString()
    values = F.col("vector") if kind == "float" else F.transform("vector", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", values.alias("vector")).where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite).withColumn("top", F.array_max(F.transform("vector", lambda x: F.abs(x).cast("double")))).where(F.col("top") > 0)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x.cast("double") / F.col("top")) * (x.cast("double") / F.col("top")))
    hashes = (F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(SEED), "vector").alias("h2"))
    return rows.select("vec_id", "vector", (F.log2("top") + F.log2(squares) / 2).alias("log_norm"), *hashes)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _indexed(rows: DataFrame, size: int, ranges: dict[int, Range], tables: int) -> DataFrame:
    """vec_id, vector, band, buckets: every candidate's bucket in each table."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                band, norm = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                found = np.zeros((batch.num_rows, tables), np.int64)
                units = _units(_matrix(batch.column(1)))
                for name in np.unique(band):
                    longest, hashed, _ = ranges[int(name)]
                    own = band == name
                    ratio = np.minimum(1.0, np.exp2(norm[own] - longest))
                    unit = np.zeros((len(ratio), hashed.padded))
                    unit[:, :size] = units[own] * ratio[:, None]
                    unit[:, size] = np.sqrt(1.0 - ratio**2)
                    found[own] = hashed.buckets_of(unit)
                ends = pa.array(np.arange(0, found.size + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))], ["vec_id", "vector", "band", "buckets"])

    kind = rows.schema["vector"].dataType.simpleString()
    made = rows.where(F.col("band") != FEW).select("vec_id", "vector", "band", "log_norm").mapInArrow(run, f"vec_id long, vector {kind}, band int, buckets array<long>")
    return made.unionByName(rows.where(F.col("band") == FEW).select("vec_id", "vector", "band", F.array(F.lit(0).cast("long")).alias("buckets")))


def _placed(index: DataFrame, ranges: dict[int, Range]) -> DataFrame:
    """vec_id, vector, PLACE, low: a row for each table."""
    bits = {name: r.hashed.low_bits for name, r in ranges.items() if r.hashed.low_bits}
    own = F.lit(0)
    for low_bits in set(bits.values()):
        own = F.when(F.col("band").isin([name for name, b in bits.items() if b == low_bits]), low_bits).otherwise(own)
    rows = index.select("vec_id", "vector", "band", own.alias("bits"), F.posexplode("buckets").alias("tab", "bucket"))
    return rows.select("vec_id", "vector", "band", "tab", F.expr("shiftright(bucket, bits)").alias("grp"), F.expr("cast(bucket & (shiftleft(1, bits) - 1) as int)").alias("low"))


def _probed(queries: DataFrame, size: int, ranges: dict[int, Range], tables: range, few: bool) -> DataFrame:
    """h1, h2, PLACE, low: the groups that every query vector probes in ``tables``, and there,
    as bits, the buckets."""
    alike: dict[Hash, list[int]] = {}
    for name, own in ranges.items():
        alike.setdefault(own.hashed, []).append(name)

    def grouped(found: np.ndarray, hashed: Hash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, mask) of the buckets found."""
        row, code = np.repeat(np.arange(len(found)), found.shape[1]), found.reshape(-1)
        group, bit = code >> hashed.low_bits, 1 << (code & ((1 << hashed.low_bits) - 1))
        order = np.lexsort((group, row))
        row, group, bit = row[order], group[order], bit[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])])
        return row[first], group[first], np.bitwise_or.reduceat(bit, first)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _units(_matrix(batch.column(2)))
                for hashed, names in alike.items():
                    unit = np.zeros((batch.num_rows, hashed.padded))
                    unit[:, :size] = units
                    for tab in tables:
                        found = hashed.probes(unit, tab, max(ranges[name].probes for name in names))
                        for name in names:
                            row, group, mask = grouped(found[:, : ranges[name].probes], hashed)
                            same = (pa.array(np.full(len(row), x, np.int32)) for x in (name, tab))
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *same, pa.array(group), pa.array(mask.astype(np.int32))], [*KEY, *PLACE, "low"])

    made = queries.select(*KEY, "vector").mapInArrow(run, "h1 long, h2 long, band int, tab int, grp long, low int")
    if not few:
        return made
    return made.unionByName(queries.select(*KEY, F.lit(FEW).alias("band"), F.lit(0).alias("tab"), F.lit(0).cast("long").alias("grp"), F.lit(1).alias("low")))


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, each summed component by component: equal vectors get
    equal products wherever they stand in a block."""
    total = np.zeros(np.broadcast_shapes(queries.shape[:-1], candidates.shape[:-1]))
    for k in range(queries.shape[-1]):
        total += queries[..., k] * candidates[..., k]
    return total


def nearest(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, product) of the k ids with the greatest products, ties to smaller
    ids; an id held by several candidates counts once, by the best of them.

    A matrix product, exact but for rounding, says which can be among them; only those are
    multiplied again component by component."""
    order = np.argsort(ids, kind="stable")
    candidates, ids = candidates[order], ids[order]
    names, first = np.unique(ids, return_index=True)
    with np.errstate(all="ignore"):
        rough = queries @ candidates.T
        slack = 1e-13 * queries.shape[1] ** 2 * np.abs(queries).max(axis=1) * np.abs(candidates).max(initial=0.0)
        if len(names) > k:
            best = rough if len(names) == len(ids) else np.maximum.reduceat(rough, first, axis=1)
            bound = np.partition(best, len(names) - k, axis=1)[:, len(names) - k] - slack
            open_ = ~(np.isfinite(rough).all(axis=1) & np.isfinite(slack))  # too large to judge
            i, at = np.nonzero((rough >= bound[:, None]) | open_[:, None])
        else:
            i, at = np.divmod(np.arange(rough.size), max(1, len(ids)))
        exact = products(queries[i], candidates[at])
    return _first(i, ids[at], np.where(np.isnan(exact), -np.inf, exact), k, len(names) < len(ids))


def _first(i: np.ndarray, found: np.ndarray, exact: np.ndarray, k: int, repeated: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query index i the k ids with the greatest products, ids that repeat once."""
    if repeated:
        by = np.lexsort((-exact, found, i))
        i, found, exact = i[by], found[by], exact[by]
        new = np.r_[True, (i[1:] != i[:-1]) | (found[1:] != found[:-1])][: len(i)]  # the best of each id
        i, found, exact = i[new], found[new], exact[new]
    by = np.lexsort((found, -exact, i))
    i, found, exact = i[by], found[by], exact[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], found[place < k], exact[place < k]


MET = "h1 long, h2 long, vec_id long, score double"


def _meet(k: int):
    """One block: candidates (vec_id, low: bucket) and query vectors (h1, h2, low: bits of the
    buckets that they probe) among the rows of a group."""

    def meet(t: pa.Table) -> pa.Table:
        asks, low = t["asks"].to_numpy(), t["low"].to_numpy()
        x, ids = _matrix(t["vector"].combine_chunks()), t["vec_id"].to_numpy()
        met = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for bucket in np.unique(low[~asks]):
            own, probing = np.flatnonzero(~asks & (low == bucket)), np.flatnonzero(asks & (low >> bucket & 1 == 1))
            if len(probing):
                i, found, score = nearest(x[probing], x[own], ids[own], k)
                met.append((probing[i], found, score))
        i, found, score = _first(*(np.concatenate(c) for c in zip(*met, strict=True)), k, True)
        return pa.table([t["h1"].take(pa.array(i)), t["h2"].take(pa.array(i)), pa.array(found), pa.array(score)], [*KEY, "vec_id", "score"])

    return meet


def _sides(held: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """Candidates and queries in one table of the blocks that they go to."""
    zero = F.lit(0).cast("long")
    return held.select("vec_id", zero.alias("h1"), zero.alias("h2"), "vector", "low", *columns, F.lit(False).alias("asks")).unionByName(asked.select(zero.alias("vec_id"), *KEY, "vector", "low", *columns, F.lit(True).alias("asks")))


def _cut(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the number of parts of their place, 1 of most."""
    if parts.count() <= CUT_PLACES:
        return rows.join(F.broadcast(parts), [*PLACE], "left")
    return join_hot(rows, parts, [*PLACE])


def _parts(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Places of more rows than a block, with the number of blocks that they fill."""
    n = rows.groupBy(*PLACE).agg(F.count("*").alias("n")).where(F.col("n") > block)
    return materialise(n.select(*PLACE, F.ceil(F.col("n") / F.lit(block)).cast("int").alias(name)), name)


def _best(met: DataFrame, k: int) -> DataFrame:
    """h1, h2, near: of each query vector the k nearest ids; at most so many leave a task."""
    first = Window.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id")
    once = met.groupBy(*KEY, "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    return ranked.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))


def _round(index: DataFrame, queries: DataFrame, parts: DataFrame, size: int, ranges: dict[int, Range], tables: range, few: bool, k: int, block: int, query_block: int) -> DataFrame:
    """h1, h2, near of ``queries`` among what they probe in ``tables``."""
    probed = materialise(_probed(queries, size, ranges, tables, few and 0 in tables), "probes")
    query_parts = _parts(probed, query_block, "query_parts")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    deal = lambda c, *by: F.pmod(F.xxhash64(*by), one(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    held = _cut(_cut(_placed(index, ranges).where(F.col("tab").isin(list(tables))), parts), query_parts)
    held = held.select("vec_id", "vector", "low", *PLACE, deal("parts", "vec_id").alias("part"), all_of("query_parts").alias("query_part"))
    asked = _cut(_cut(probed, parts), query_parts)
    asked = asked.select(*KEY, "low", *PLACE, all_of("parts").alias("part"), deal("query_parts", *KEY).alias("query_part")).join(queries, [*KEY])
    met = _sides(held, asked, *PLACE, "part", "query_part").groupBy(*PLACE, "part", "query_part").applyInArrow(_meet(k + 1), MET)
    near = materialise(_best(met, k + 1), "near")
    discard(probed, query_parts)
    return near


def search(vectors: DataFrame, is_query: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, tables: int = TABLES, probes: int | None = None, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of every row with ``is_query`` (a condition on vec_id)
    the k nearest others found.  ``probes``: buckets probed in each table."""
    bounded_batches(vectors.sparkSession)
    rows = valid(inputs(vectors, vec_id=id_col, vector=vector_col).withColumn("vec_id", F.col("vec_id").cast("long")))
    rows = materialise(rows.groupBy(*KEY, "vec_id").agg(F.first("vector").alias("vector"), F.first("log_norm").alias("log_norm")), "vectors")
    common = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.max("log_norm").alias("longest")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    size = common["size"]
    rows = rows.where(F.size("vector") == size)
    asks = materialise(rows.where(is_query).select(F.col("vec_id").alias("query_id"), *KEY), "asks")
    alike = Window.partitionBy(*KEY).orderBy("vec_id")
    kept = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1)
    kept = materialise(kept.withColumn("band", F.floor(2 * (F.lit(common["longest"]) - F.col("log_norm"))).cast("int")), "candidates")
    ranges, hashes, n, few = {}, {}, 0, False
    for band, longest, own in kept.groupBy("band").agg(F.max("log_norm"), F.count("*")).collect():  # some thousand at most, as doubles go
        n += own
        if own <= FEW_ROWS:
            few = True
        else:
            power = max(0, round(math.log2(own / BUCKET_ROWS)))
            hashed = hashes.setdefault(power, Hash(size, BUCKET_ROWS << power, tables))
            ranges[band] = Range(longest, hashed, min(hashed.buckets, probes or probes_for(own, hashed.buckets)))
    band = F.when(F.col("band").isin(list(ranges)), F.col("band")).otherwise(FEW) if ranges else F.lit(FEW)
    index = materialise(_indexed(kept.withColumn("band", band), size, ranges, tables), "index")
    queries = materialise(kept.where("place = 1").join(asks.select(*KEY).distinct(), [*KEY], "left_semi").select(*KEY, "vector"), "queries")
    parts = _parts(_placed(index, ranges).select(*PLACE), block, "parts")
    at_once, slices = rounds_for(n, queries.count(), sum(r.probes for r in ranges.values()) + few, tables, 8 * size)
    met = []
    for first in range(0, tables, at_once):
        for part in range(slices):
            met.append(_round(index, queries.where(F.pmod(F.xxhash64(*KEY, F.lit(SEED)), F.lit(slices)) == part), parts, size, ranges, range(first, min(tables, first + at_once)), few, k, block, query_block))
    near = met[0]
    if len(met) > 1:
        rows = reduce(DataFrame.unionByName, met).select(*KEY, F.explode("near").alias("x")).select(*KEY, "x.vec_id", "x.score")
        near = materialise(_best(rows, k + 1), "near")
        discard(*met)
    discard(index, parts)
    poor = materialise(queries.join(near.where(F.size("near") > k), [*KEY], "left_anti"), "poor")
    if m := poor.count():
        # every candidate against every such query, in blocks
        q_parts, c_parts = -(-m // query_block), -(-n // block)
        held = kept.select("vec_id", "vector", F.lit(0).alias("low"), F.pmod(F.xxhash64("vec_id"), F.lit(c_parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("query_part"))
        asked = poor.select(*KEY, "vector", F.lit(1).alias("low"), F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1))).alias("part"), F.pmod(F.xxhash64(*KEY), F.lit(q_parts)).cast("int").alias("query_part"))
        met = _sides(held, asked, "part", "query_part").groupBy("part", "query_part").applyInArrow(_meet(k + 1), MET)
        near = near.join(poor, [*KEY], "left_anti").unionByName(_best(met, k + 1))
    told = join_hot(asks, near, [*KEY], "inner").select("query_id", F.explode("near").alias("x"))
    told = told.select("query_id", "x.vec_id", "x.score").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return told.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

