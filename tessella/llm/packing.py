"""Operator 1: best-fit packing of documents into sequences of a fixed number of tokens.

Hierarchical residual packing.  Documents become pieces of at most ``max_tokens`` tokens.
Every partition packs its own pieces by best fit (longest first, into the fullest bin that
still has room).  Bins that are nearly full are final.  The underfull ones become items of
the next round, where fewer and fewer groups each pack the bins of several former groups
again, until one bounded group is left or a round no longer saves bins.

Defined results: a null text counts as empty and still gives one piece (the end token);
longer documents are cut every ``max_tokens`` tokens; special tokens that a text spells out are
those tokens, as the tokenizer has it; repeated rows are packed as often as they occur; an empty
table gives no rows; a null id stays null.  Texts without spaces are one chunk, held once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.chunks import ChunkTable
from tessella.llm.common import bounded_batches, inputs, kept, map_batches, map_task, materialise, text_or_empty
from tessella.shipping import ship

MAX_TOKENS = 2048
END_TOKEN = 0
#: Bins with at most so many free tokens are final at once.
SLACK = 2
#: Items that one group packs at a time; bounds a task's memory.
GROUP_ITEMS = 20_000
#: Texts whose chunks are looked up together, and their bytes: more find more copies and take
#: more memory.
TEXT_ROWS, TEXT_BYTES = 8_192, 16 << 20
#: Former groups whose bins meet in one group of the next round.
FAN_IN = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "bin_id long, used long, doc_id array<long>, piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>"
MEMBERS = ("doc_id", "piece", "start", "length", "ids_crc32")
PACKED = f"{PIECES}, sequence_id long, offset long"


#: Words of these letters are one pre-token each, whatever stands beside them, and so is a run of
#: ASCII punctuation behind them.
LETTERS = [*map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)])]
WORDED = r"^(?P<word>[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]{0,4})$"


def encoder(vocabulary: str) -> ChunkTable:
    """Chunks to little-endian 32-bit ids, by a tokenizers file whose words end at spaces.

    A chunk that is a plain word, perhaps capitalised and with punctuation behind it, is put
    together from its parts, and each word is merged once, however it is written; all others go
    to the tokenizer as they are."""
    encoders: dict[str, ChunkTable] = kept(__name__)
    if vocabulary not in encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        merged = tokenizer.model.tokenize
        letters = {ord(x): tokenizer.pre_tokenizer.pre_tokenize_str(x)[0][0] for x in LETTERS}

        def ids(text: str) -> np.ndarray:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

        # a special token stands between chunks; chunks that may hold one themselves go alone
        special = [x.content for x in tokenizer.get_added_tokens_decoder().values() if x.special]
        between = tokenizer.token_to_id(special[0]) if special else -1
        heads = {x.lower()[:2] for x in special}

        def apart(chunks: list[str]) -> Iterator[bytes]:
            for at in range(0, len(chunks), 2_000):
                own = np.array(tokenizer.encode(special[0].join(chunks[at : at + 2_000]), add_special_tokens=False).ids, "<u4")
                ends = (4 * np.flatnonzero(own == between)).tolist()
                raw = own.tobytes()
                yield from (raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True))

        def spell(words: pa.Array) -> pa.Array:
            own = [[x.id for x in merged(w if w.isascii() else w.translate(letters))] for w in words.to_pylist()]
            ends = np.fromiter(accumulate((4 * len(x) for x in own), initial=0), "i8")
            raw = np.fromiter(chain.from_iterable(own), "<u4")
            return pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(raw)])

        spelt = ChunkTable(spell)

        def encode(chunks: pa.Array) -> pa.Array:
            parts = pc.extract_regex(chunks, WORDED)
            plain = parts.is_valid()
            words, tails = parts.filter(plain).flatten()
            tails = tails.dictionary_encode()
            behind = pa.array([ids(x).tobytes() for x in tails.dictionary.to_pylist()], pa.large_binary())
            made = pc.binary_join_element_wise(spelt.look_up(pc.utf8_lower(words)), behind.take(tails.indices), pa.scalar(b"", pa.large_binary()))
            others = chunks.filter(pc.invert(plain)).to_pylist()
            alone = [not special or any(x in chunk.lower() for x in heads) for chunk in others]
            together = apart([chunk for chunk, own in zip(others, alone, strict=True) if not own])
            rest = pa.array([ids(chunk).tobytes() if own else next(together) for chunk, own in zip(others, alone, strict=True)], pa.large_binary())
            places = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
            order = np.empty(len(chunks), "i8")
            order[places] = np.arange(len(chunks))
            return pa.concat_arrays([made, rest]).take(pa.array(order))

        encoders[vocabulary] = ChunkTable(encode)
    return encoders[vocabulary]


def gathered(batches: Iterable[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to these bounds; larger ones stay as they are."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if held and (rows + batch.num_rows > most_rows or size + batch.nbytes > most_bytes):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encoded(texts: pa.Array, cache: ChunkTable) -> tuple[memoryview, list[int]]:
    """The ids of all texts, one behind the other, and where each text's begin and end in bytes."""
    chunked = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
    _, offsets, data = cache.look_up(chunked.flatten()).buffers()
    ends = np.frombuffer(offsets, "i8")[chunked.offsets.to_numpy()]
    return memoryview(data or b""), ends.tolist()


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return inputs(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))


def _tokenized(vocabulary: str, max_tokens: int, end_token: int, with_ids: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of doc_id and text to batches of pieces."""
    end = np.array([end_token], "<u4").tobytes()
    step = 4 * max_tokens
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(vocabulary)
        for batch in gathered(batches, TEXT_ROWS, TEXT_BYTES):
            raw, ends = encoded(batch.column(1), cache)
            out: list[list] = [[], [], [], [], []]
            ids = []
            for doc_id, (first, last) in zip(batch.column(0).to_pylist(), pairwise(ends), strict=True):
                size = last - first + 4
                for k, at in enumerate(range(0, size, step)):
                    part, close = raw[first + at : min(first + at + step, last)], end if at + step >= size else b""
                    for column, value in zip(out, (doc_id, k, at // 4, (len(part) + len(close)) // 4, zlib.crc32(close, zlib.crc32(part))), strict=True):
                        column.append(value)
                    if with_ids:
                        ids.append(np.frombuffer(bytes(part) + close, "<u4").astype("i8"))
            arrays = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, [*MEMBERS, *["ids"] * with_ids])

    return run


def tokenize_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    run = _tokenized(vocabulary, max_tokens, end_token, with_ids)
    return map_task(_docs(docs, id_col, text_col), run, PIECES + (", ids array<long>" if with_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin.  Ties go to the earlier item and the bin
    that got its last item latest."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room for exactly r
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[own].append(item)
            room -= size
        else:
            own, room = len(bins), capacity - size
            bins.append([item])
        by_room[room].append(own)
        rooms |= 1 << room
    return bins


def _bins_batch(first_id: int, used: list[int], members: list[list[np.ndarray]]) -> pa.RecordBatch:
    """members: for each bin one array a column of MEMBERS."""
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(m[0]) for m in members]))), pa.int32())
    arrays = [pa.array(np.arange(first_id, first_id + len(used))), pa.array(used, pa.int64())]
    for k, name in enumerate(MEMBERS):
        values = pa.concat_arrays([m[k] for m in members])
        arrays.append(pa.ListArray.from_arrays(offsets, values.cast(pa.int32() if name == "piece" else pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, ["bin_id", "used", *MEMBERS])


def _id_base(level: int, part: int) -> int:
    return (level << 57) | (part << 32)


def _packed_local(max_tokens: int, group_items: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Round 0: best fit of the pieces of each partition, ``group_items`` at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = _id_base(0, TaskContext.get().partitionId())
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held
            t = pa.Table.from_batches(held).combine_chunks()
            held = []
            sizes = t["length"].to_numpy()
            bins = best_fit(sizes, max_tokens)
            order = pa.array(np.concatenate(bins))
            columns = [t[c].take(order).combine_chunks() for c in MEMBERS]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            ends = np.cumsum([len(b) for b in bins])
            members = [[c.slice(e - len(b), len(b)) for c in columns] for b, e in zip(bins, ends, strict=True)]
            out = _bins_batch(next_id, [int(sizes[b].sum()) for b in bins], members)
            next_id += len(bins)
            return out

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= group_items:
                yield flush()
                rows = 0
        if held:
            yield flush()

    return run


def pack_again(bins: DataFrame, level: int, groups: int, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Round ``level``: best fit of underfull bins, dealt to ``groups`` groups by their ids."""

    def run(t: pa.Table) -> pa.Table:
        group = t["grp"][0].as_py()
        t = t.sort_by("bin_id").combine_chunks()
        sizes = t["used"].to_numpy()
        packed = best_fit(sizes, max_tokens)
        lists = [t[c].chunk(0) for c in MEMBERS]
        members = [[pa.concat_arrays([c[i].values for i in b]) for c in lists] for b in packed]
        return pa.Table.from_batches([_bins_batch(_id_base(level, group), [int(sizes[b].sum()) for b in packed], members)])

    dealt = bins.withColumn("grp", F.pmod(F.xxhash64("bin_id"), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInArrow(run, BINS)


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, slack: int = SLACK, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces (columns of PIECES) with the sequence_id and offset of each."""
    ship(pieces.sparkSession)
    return _pack_rounds(map_task(pieces, _packed_local(max_tokens, group_items), BINS), max_tokens, slack, group_items, fan_in)


def _pack_rounds(local: DataFrame, max_tokens: int, slack: int = SLACK, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """The rounds after 0, and the pieces of all bins."""
    spark = local.sparkSession
    bins = materialise(local, "bins0")
    done = [bins.where(F.col("used") >= max_tokens - slack)]
    rest = bins.where(F.col("used") < max_tokens - slack)
    left, smallest, groups, level = *rest.agg(F.count("*"), F.min("used")).first(), None, 0
    while left:
        closed = F.col("used") > max_tokens - smallest  # no other bin fits into these
        done.append(rest.where(closed))
        rest = rest.where(~closed)
        left = rest.count()
        if not left:
            break
        groups = max(1, -(-left // group_items), 0 if groups is None else -(-groups // fan_in))
        if groups > 1 and level == 0:
            groups = max(-(-left // group_items), min(groups, spark.sparkContext.defaultParallelism))
        level += 1
        again = materialise(pack_again(rest, level, groups, max_tokens), f"bins{level}")
        full = F.col("used") >= max_tokens - slack
        done.append(again.where(full))
        rest = again.where(~full)
        total, now, smallest = again.agg(F.count("*"), F.count_if(~full), F.min(F.when(~full, F.col("used")))).first()
        if groups == 1 or total >= left:
            done.append(rest)
            break
        left = now
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = {c: batch.column(batch.schema.get_field_index(c)) for c in ("bin_id", *MEMBERS)}
        counts = lists["length"].value_lengths().to_numpy()
        flat = [lists[c].flatten() for c in MEMBERS]
        lengths = flat[3].to_numpy()
        starts = np.cumsum(lengths) - lengths
        firsts = np.cumsum(counts) - counts
        offset = starts - np.repeat(starts[firsts], counts)
        return pa.RecordBatch.from_arrays([*flat, pa.array(np.repeat(lists["bin_id"].to_numpy(), counts)), pa.array(offset, pa.int64())], [*MEMBERS, "sequence_id", "offset"])

    return map_batches(out, lambda: rows, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Tokenize and pack: one row a piece, with its sequence and its offset there.

    A task does both in one worker; a worker for each would be two a core, and as tasks take
    whichever is free, both would learn the same chunks."""
    tokenized, packed = _tokenized(vocabulary, max_tokens, END_TOKEN), _packed_local(max_tokens, GROUP_ITEMS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(tokenized(batches))

    return _pack_rounds(map_task(_docs(docs, id_col, text_col), run, BINS), max_tokens)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The token sequences themselves: sequence_id, n_tokens, input_ids.  ``packed`` comes
    from pack_documents over ``docs``, whose ids must be unique here."""
    pieces = tokenize_pieces(docs, vocabulary, id_col, text_col, max_tokens, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda x: x["ids"]))
    return placed.groupBy("sequence_id").agg(ids.alias("input_ids")).select("sequence_id", F.size("input_ids").alias("n_tokens"), "input_ids")
