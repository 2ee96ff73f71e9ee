"""Operator 11: the prefix trie of conversations, by merging sorted runs that know their LCPs.

A turn is the digest of its role and text, so a conversation is a row of digests and the texts
are read once.  Equal conversations become one row with a count, rows are dealt by ranges of
their digests, and each task merges its batches as sorted runs: every key carries how many turns
it shares with the one before in its run, and a loser tree compares two heads only from the turn
on up to which both equal the last one out.  The merged stream runs over a stack of open nodes;
a node is finished when the next key leaves it, and hands its sums to its parent.

Nodes on a task's first and last path may go on in a neighbour: they leave it as border rows, two
a task, and are stitched by the same stack in groups of ``FAN`` tasks, until one group is left.

What grows with one conversation or one node stays bounded in memory.  Turns are numbered by a
window (a sort that spills), and a conversation longer than ``SEGMENT`` turns is cut: a segment
is a path in the trie below the node where it begins, named by the digests before it.  Tries of
deeper segments are made first, and their sums are handed to the node that they hang from.
Members that end at a node are joined to text in blocks of ids and hashed as a stream; SHA-256
goes over all of them in order, so one node's ids pass through one task, 4096 ids a row.

Rebuilding: conversation c takes the first h turns of the conversation c - c % GROUP, then its
own turns behind its first h; h = crc32(c) % SHARED.  A block of ids is dealt to a task once.

Defined results: rows without a conversation id take no part; a null role or text is empty; a
null turn comes first, equal turns in the order of their digests, so rows that repeat are turns
of their own; a conversation whose rebuilt form has no turn ends at the root; an empty table
gives no rows; further columns, of any name, are not read; texts of any length are one digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, discard, inputs, join_hot, materialise, text_or_empty

GROUP, SHARED = 5, 9
#: Bytes of a turn's digest; turns of a segment; border tasks stitched at once.
UNIT, SEGMENT, FAN = 16, 512, 256
#: Bytes of keys that a merging task gets, rows that are worth a task, rows of an Arrow batch.
PART_BYTES, PART_ROWS, RUN_ROWS = 8 << 20, 2_000, 2_048
#: Ids of one block (a power of two) of the members that end at a node.
BLOCK_BITS = 12
ROOT = "00" * UNIT
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def _short(text: Column) -> Column:
    """The first ``UNIT`` bytes of a SHA-256, as hex digits."""
    return F.substring(F.sha2(text, 256), 1, 2 * UNIT)


def _lent(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """(block, conv, depth, unit, bytes): all turns of the rebuilt conversations from depth 1 on,
    and a row of depth 0 for each conversation."""
    own = inputs(turns, **dict(zip(("conv", "turn", "role", "text"), columns, strict=True)))
    role, text = text_or_empty(F.col("role")), text_or_empty(F.col("text"))
    unit = _short(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    own = own.where("conv is not null").select(F.col("conv").cast("long").alias("conv"), "turn", unit.alias("unit"), F.octet_length(text).cast("long").alias("bytes"))
    own = own.withColumn("block", F.col("conv") - F.col("conv") % GROUP)
    whole = Window.partitionBy("block")
    first = F.col("conv") == F.col("block")
    own = own.withColumns({"n_first": F.count_if(first).over(whole), "convs": F.collect_set("conv").over(whole)})  # fewer than 2 GROUP ids
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("block", "conv").orderBy(F.asc_nulls_first("turn"), "unit", "bytes")))
    row = lambda conv, depth: F.struct(conv.alias("conv"), depth.cast("long").alias("depth"))
    none = F.array().cast("array<struct<conv:bigint,depth:bigint>>")
    conv, place, h = F.col("conv"), F.col("place"), _lent(F.col("conv"))
    kept = F.when(place > h, F.array(row(conv, F.least(h, F.col("n_first")) + place - h))).otherwise(none)
    lent = F.when(first & (place < SHARED), F.transform(F.filter("convs", lambda c: _lent(c) >= place), lambda c: row(c, place))).otherwise(none)
    mark = F.when(place == 1, F.array(row(conv, F.lit(0)))).otherwise(none)
    return own.select("block", "unit", "bytes", F.inline(F.concat(kept, lent, mark))).select("block", "conv", "depth", "unit", "bytes")


def segments(turns: DataFrame, size: int) -> DataFrame:
    """(conv, seg, root, units, sizes, end, last): conversations cut into runs of ``size``
    turns.  ``root`` and ``end`` name the nodes before and at the end of a segment."""
    cut = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / size).cast("int")
    turn = F.when(F.col("depth") > 0, F.struct("depth", "unit", "bytes"))
    own = turns.groupBy("block", "conv", cut.alias("seg")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))  # at most ``size`` of them
    own = own.select("block", "conv", "seg", F.col("turns.unit").alias("own"), F.col("turns.bytes").alias("sizes"))
    by_seg = Window.partitionBy("block", "conv").orderBy("seg")
    digest = F.sha2(F.concat(F.col("seg").cast("string"), F.lit(":"), F.array_join("own", "")), 256)
    pieces = {f"p{k}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}  # sums of numbers below 2**32
    own = own.withColumns(pieces)
    upto = lambda end: _short(F.concat_ws(",", *(F.sum(p).over(by_seg.rowsBetween(Window.unboundedPreceding, end)).cast("string") for p in pieces)))
    own = own.withColumns({"root": F.when(F.col("seg") == 0, ROOT).otherwise(upto(-1)), "next": upto(0), "last": F.lead("seg").over(by_seg).isNull()})
    chain = F.aggregate("own", F.col("root"), lambda node, unit: _short(F.concat(node, unit)))
    end = F.when(F.size("own") == size, F.col("next")).otherwise(chain)
    return own.select("conv", "seg", F.unhex("root").alias("root"), F.unhex(F.array_join("own", "")).alias("units"), "sizes", F.unhex(end).alias("end"), "last")


class Node:
    __slots__ = ("border", "children", "conv", "leaves", "members", "name", "saved", "size")

    def __init__(self, name: bytes, size: int, border: bool):
        self.name, self.size, self.border = name, size, border
        self.members, self.conv, self.children, self.leaves, self.saved = 0, None, 0, 0, 0

    def add(self, members: int, conv: int | None, children: int, leaves: int, saved: int) -> None:
        self.members += members
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def sums(self) -> tuple:
        return self.members, self.conv, self.children, self.leaves, self.saved


class OpenPath:
    """The stack of open nodes under a sorted stream of keys.  With ``whole`` the stream is all
    there is; else nodes of its first and last path stay unfinished, as border rows."""

    def __init__(self, whole: bool):
        self.whole, self.open, self.finished, self.first, self.last, self.left = whole, [], [], None, None, {}

    def add(self, key: bytes, shared: int, sizes: list[int], end: bytes, sums: list[tuple[int, tuple]]) -> None:
        """A key that has ``shared`` units in common with the one before; ``sums`` are added to
        the nodes at their depths.  Unit 0 is the root of the trie that the key lies in."""
        self.close(shared)
        depth = len(key) // UNIT
        border = not self.whole and self.first is None
        for d in range(len(self.open), depth):
            unit = key[d * UNIT : (d + 1) * UNIT]
            if d == 0:
                name = unit
            elif d == depth - 1:
                name = end
            else:
                name = hashlib.sha256((self.open[-1].name.hex() + unit.hex()).encode()).digest()[:UNIT]
            self.open.append(Node(name, sizes[d - 1] if d else 0, border))
        for d, own in sums:
            self.open[d].add(*own)
        self.last = (key, sizes, end)
        if self.first is None:
            self.first = self.last

    def close(self, keep: int) -> None:
        while len(self.open) > keep:
            node = self.open.pop()
            if node.border:
                self.left[len(self.open)] = node.sums()
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.members - 1) * node.size
            parent = self.open[-1] if self.open else None
            self.finished.append((node.name, parent.name if parent else None, len(self.open), node.conv, node.members, node.children, leaves, saved))
            if parent:
                parent.add(node.members, node.conv, 1, leaves, saved)

    def borders(self) -> list[tuple]:
        """(key, sizes, end, sums by depth) of the first and the last path, in this order."""
        if self.whole:
            self.close(0)
            return []
        right = {d: node.sums() for d, node in enumerate(self.open)}
        return [(*path, sums) for path, sums in ((self.first, self.left), (self.last, right)) if path and sums]


def shared_units(a: bytes, b: bytes, at: int = 0) -> int:
    """How many units a and b have in common, ``at`` of which are known."""
    most = min(len(a), len(b)) // UNIT
    while at < most and a[at * UNIT : (at + 1) * UNIT] == b[at * UNIT : (at + 1) * UNIT]:
        at += 1
    return at


def sorted_run(rows: list[tuple]) -> list[tuple]:
    """Rows (key, ...) as (shared with the row before, key, ...) in order."""
    out, before = [], b""
    for row in sorted(rows, key=lambda r: r[0]):
        out.append((shared_units(before, row[0]), *row))
        before = row[0]
    return out


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """The rows of sorted runs in order, each with what it shares with the one before.

    A loser tree: each inner node keeps the run that lost there, with what its head shares with
    the head that won.  Of two heads the one that shares more with the last row out is smaller;
    only where both share as much are they compared, from there on."""
    k = len(runs)
    at, shared = [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if at[b] >= len(runs[b]):
            return a, b
        if at[a] >= len(runs[a]):
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        one, two = runs[a][at[a]][1], runs[b][at[b]][1]
        same = shared_units(one, two, shared[a])
        winner, loser = (a, b) if one[same * UNIT : (same + 1) * UNIT] <= two[same * UNIT : (same + 1) * UNIT] else (b, a)
        shared[loser] = same
        return winner, loser

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k else 0
    while k and at[best] < len(runs[best]):
        yield (shared[best], *runs[best][at[best]][1:])
        at[best] += 1
        if at[best] < len(runs[best]):
            shared[best] = runs[best][at[best]][0]
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


SUMS = ("members", "conv", "children", "leaves", "saved")
OUT = pa.schema(
    [("name", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("members", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]
    + [("part", pa.int64()), ("side", pa.int64()), ("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("end", pa.binary()), ("depths", pa.list_(pa.int64()))]
    + [(f"all_{c}", pa.list_(pa.int64())) for c in SUMS]
)
OUT_SQL = "name binary, parent binary, depth long, conv long, members long, children long, leaves long, saved long, part long, side long, key binary, sizes array<long>, end binary, depths array<long>, " + ", ".join(f"all_{c} array<long>" for c in SUMS)


def _batch(finished: list[tuple], borders: list[tuple], part: int) -> pa.RecordBatch:
    rows = [(*f, *[None] * 11) for f in finished]
    for side, (key, sizes, end, sums) in enumerate(borders):
        rows.append((*[None] * 8, part, side, key, sizes, end, list(sums), *(list(c) for c in zip(*sums.values(), strict=True))))
    columns = zip(*rows, strict=True) if rows else [[]] * len(OUT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


def _merge(whole: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (part, root, units, sizes, end, members, conv, children, leaves, saved) of one
    range to its finished nodes and border rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, part = [], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            if columns[0]:
                part = columns[0][0]
                runs.append(sorted_run([(root + units, sizes, end, sums) for root, units, sizes, end, *sums in zip(*columns[1:], strict=True)]))
        path = OpenPath(whole)
        for shared, key, sizes, end, sums in merged(runs):
            path.add(key, shared, sizes, end, [(len(key) // UNIT - 1, tuple(sums))])
            if len(path.finished) >= RUN_ROWS:
                yield _batch(path.finished, [], part)
                path.finished = []
        yield _batch([], path.borders(), part)
        yield _batch(path.finished, [], part)

    return run


def _stitch(whole: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """The same stack over the border rows of neighbouring tasks."""

    def run(group: tuple, table: pa.Table) -> pa.Table:
        path, before = OpenPath(whole), b""
        for row in sorted(table.to_pylist(), key=lambda r: (r["part"], r["side"])):
            sums = list(zip(row["depths"], zip(*(row[f"all_{c}"] for c in SUMS), strict=True), strict=True))
            path.add(row["key"], shared_units(before, row["key"]), row["sizes"], row["end"], sums)
            before = row["key"]
        borders = path.borders()
        return pa.Table.from_batches([_batch(path.finished, borders, group[0].as_py())])

    return run


def trie(rows: DataFrame) -> list[DataFrame]:
    """Nodes (name, parent, depth, conv, members, children, leaves, saved) of distinct paths
    (root, units, sizes, end, members, conv, children, leaves, saved), a written table."""
    spark = rows.sparkSession
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("units") + F.lit(64)), F.lit(0))).first()
    parts = max(1, -(-size // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS))
    dealt = rows.select("root", "units", "sizes", "end", *SUMS)
    if parts > 1:
        dealt = dealt.repartitionByRange(parts, "root", "units")
    else:
        dealt = dealt.coalesce(1)  # fewer rows and bytes than a task is worth
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "*")
    bounded_batches(spark, RUN_ROWS)
    out = materialise(dealt.mapInArrow(_merge(parts == 1), OUT_SQL), "nodes")
    found = [out]
    while parts > 1:
        parts = out.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0] + 1
        if not parts:
            break
        whole = parts <= FAN
        border = out.where("part is not null").withColumn("group", F.floor(F.col("part") / FAN).cast("long"))
        out = materialise(border.groupBy("group").applyInArrow(_stitch(whole), OUT_SQL), "nodes")
        found.append(out)
        if whole:
            break
    return [df.where("part is null").select("name", "parent", "depth", *SUMS) for df in found]


def member_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the nodes (end) where conversations (conv) end."""
    block = F.shiftright("conv", BLOCK_BITS)
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("end", block.alias("block")).agg(text.alias("ids"))  # 4096 ids at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for end, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if end == name:
                    state.update(b",")
                else:
                    if name is not None:
                        out.append((name, state.hexdigest()))
                    name, state = end, hashlib.sha256()
                state.update(ids.encode())
            yield _named(out)
        if name is not None:
            yield _named([(name, state.hexdigest())])

    return blocks.repartition("end").sortWithinPartitions("end", "block").select("end", "ids").mapInArrow(run, "name binary, ends_sha256 string")


def _named(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["name", "ends_sha256"])


def prefix_trie(turns: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), segment: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), a row a node of the trie of the rebuilt conversations."""
    spark = turns.sparkSession
    bounded_batches(spark, RUN_ROWS)
    cut = materialise(segments(rebuilt(turns, columns), segment), "segments")
    alike = cut.groupBy("seg", "root", "units").agg(F.first("sizes").alias("sizes"), F.first("end").alias("end"), F.count("*").alias("members"), F.min("conv").alias("conv"))
    paths = materialise(alike, "paths")
    deepest = paths.agg(F.coalesce(F.max("seg"), F.lit(0))).first()[0]
    nodes, below = [], None
    for seg in range(deepest, -1, -1):
        rows = paths.where(F.col("seg") == seg)
        if below is None:
            rows = rows.select("*", *(F.lit(0).cast("long").alias(c) for c in SUMS[2:]))
        else:
            rows = rows.join(below, "end", "left").na.fill(0, list(SUMS[2:]))
        own = trie(materialise(rows, "level") if below is not None else rows)
        made = own[0]
        for more in own[1:]:
            made = made.unionByName(more)
        if seg:
            below = made.where("depth = 0").select(F.col("name").alias("end"), *SUMS[2:])
            made = made.where("depth > 0")
        nodes.append(made.withColumn("depth", F.col("depth") + seg * segment))
    whole = nodes[0]
    for more in nodes[1:]:
        whole = whole.unionByName(more)
    whole = materialise(whole, "trie")
    parents = whole.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    out = join_hot(whole, parents, ["parent"]).join(member_digests(cut.where("last").select("end", "conv")), "name", "left")
    found = {"conv_id": "conv", "depth": "depth", "parent_conv_id": "parent_conv_id", "n_convs": "members", "n_children": "children", "n_leaves": "leaves", "saved_tokens": "saved"}
    discard(paths)
    return out.select(*(F.col(c).alias(n) for n, c in found.items()), F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))
