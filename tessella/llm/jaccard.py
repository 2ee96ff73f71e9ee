"""Operator 10: near-duplicate join on word n-gram sets, by MinHash banding.

1. Every text becomes its set of word n-grams (64-bit hashes of lower-cased words).  Texts
   with equal sets form one node, whose representative is its row of the smallest id.
2. Representatives get a MinHash signature, cut into bands; the numbers of bands and rows
   are chosen for a target recall at the threshold.  Band hashes are shuffled; those held by
   two or more representatives are buckets.
3. Pairs are verified on full n-gram sets, without a row for each pair: every candidate
   belongs to a block of bounded size (documents and n-grams), cut from a populous bucket near
   it.  Two blocks that share a bucket meet in one task, which counts the links of each
   document and reduces them to a spanning forest.  A large bucket so becomes many block pairs,
   dealt to all tasks.  The sets of candidates come from a second pass over the texts, where a
   Bloom filter of bounded size keeps nearly all others from the shuffle.
4. Linked representatives are joined into groups by label propagation with shortcuts.

Defined results: a text of fewer than n words has one n-gram, all of its words; texts without
a word (null ones too: empty) are copies only of texts equal to them; every row gives one row
of the result; rows without an id are compared like all others, behind all ids, and their class
id is null only where no row of their class has one; a very long text is one document of a
block; an empty table gives no rows; columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, discard, inputs, kept, map_batches, map_task, materialise, text_or_empty

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Most hashes in a signature.
SIGNATURE = 128
#: Documents and n-grams in a block, about.
BLOCK, BLOCK_NGRAMS = 512, 400_000
#: Bits a candidate in the Bloom filter, hashes of each, and the most 64-bit words (16 MB).
BLOOM_BITS, BLOOM_HASHES, BLOOM_WORDS = 16, 4, 1 << 21
#: Word hashes that a worker remembers.
WORD_CACHE = 150_000

words_of = re.compile(r"\w+").findall


def choose_bands(threshold: float, recall: float = RECALL, most: int = SIGNATURE) -> tuple[int, int]:
    """(bands, rows): as many rows a band, so as few false candidates, as reach the recall
    of a pair that is just at the threshold within ``most`` hashes."""
    for rows in range(16, 0, -1):
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall within the signature's length")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngram_set(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text's words."""
    words = words_of(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    hashes: dict[str, int] = kept(__name__)
    if len(hashes) > WORD_CACHE:
        hashes.clear()
    for w in set(words).difference(hashes):
        hashes[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    total = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(total))


class Signer:
    """Band hashes of n-gram sets, alike on every worker."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_240_501)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def __call__(self, ngrams: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, 2**32 - 1, np.uint32)
        x = (ngrams >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(low, (x[at : at + 1024, None] * self.a + self.b).min(axis=0), out=low)
        parts = low.reshape(self.bands, self.rows).astype(np.uint64)
        total = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
        return total.view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    slim = inputs(docs, doc_id=id_col, text=text_col)
    text = text_or_empty(F.col("text"))
    return slim.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def signatures(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, set digest (two longs), n-grams, band hashes."""

    def start():
        signer = Signer(bands, rows)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            high, low, size, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = ngram_set(text, n)
                whole = xxhash.xxh3_128_digest(own.tobytes() if len(own) else b"\0" + text.encode("utf-8", "surrogatepass"))
                h = np.frombuffer(whole, "<i8")
                high.append(int(h[0]))
                low.append(int(h[1]))
                size.append(len(own))
                keys.append(signer(own) if len(own) else np.empty(0, np.int64))
            arrays = [batch.column(0), batch.column(2), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "d1", "d2", "n_ngrams", "keys"])

        return step

    return map_batches(texts, start, "doc_id long, text_key long, d1 long, d2 long, n_ngrams long, keys array<long>")


def _overlaps(sets: list[np.ndarray], most_cells: int = 4_000_000) -> np.ndarray:
    """Sizes of the intersections of all sets of a block pair."""
    m = len(sets)
    names, member = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(names, kind="stable")
    names, member = names[order], member[order]
    new = np.r_[True, names[1:] != names[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    member, column = member[keep], (np.cumsum(shared) - 1)[column[keep]]
    total = np.zeros((m, m), np.float32)  # exact: counts stay below 2**24
    width = max(1, most_cells // m)
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((m, width), np.float32)
        block[member[a:b], column[a:b] - at] = 1
        total += block @ block.T
    return total.astype(np.int64)


def _verify(ids: list[int], blocks: np.ndarray, sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, int]]:
    """(id, links, root in the spanning forest) of the documents that have links here.  With
    two blocks, only links between them count."""
    sizes = np.array([len(s) for s in sets])
    common = _overlaps(sets)
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if blocks.min() != blocks.max():
        linked &= blocks[:, None] != blocks[None, :]
    counts = linked.sum(axis=1)
    seen = np.zeros(len(ids), bool)
    for first in np.flatnonzero(counts):
        if seen[first]:
            continue
        group, edge = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        group[first] = edge[first] = True
        while edge.any():
            edge = linked[edge].any(axis=0) & ~group
            group |= edge
        seen |= group
        root = min(ids[i] for i in np.flatnonzero(group))
        for i in np.flatnonzero(group):
            yield ids[i], int(counts[i]), root


def components(edges: DataFrame) -> DataFrame:
    """id and label (the smallest id reachable) of every id in ``edges`` (columns u, v).

    Every round takes the smallest label among the neighbours and then the label's label;
    it is written to the shared folder, so a lost executor costs no earlier round, and then
    the round before it is deleted.  What is returned may be discarded like a written table."""
    both = edges.where("u <> v")
    both = materialise(both.union(both.select("v", "u")).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    before = labels
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        now = materialise(lower.join(jump, "label", "left").select("id", "was", F.least("label", "further").alias("label")), "labels")
        changed = now.where("label <> was").limit(1).count()
        discard(before)
        before, labels = now, now.select("id", "label")
        if not changed:
            discard(both)
            labels.tessella_path = now.tessella_path
            return labels


def _node() -> Column:
    return F.xxhash64("d1", "d2")


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id, text_key, d1, d2 of every row, and of every set (d1, d2) its
    representative row (rep: last, doc_id, text_key), n_copies, label of its group, n_links."""
    texts = _texts(docs, id_col, text_col)
    bands, rows = choose_bands(threshold, recall)
    signed = materialise(signatures(texts, n, bands, rows), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("rep")
    nodes = signed.groupBy("d1", "d2").agg(rep, F.count("*").alias("n_copies"), F.first("n_ngrams").alias("n_ngrams"), F.first("keys").alias("keys"))
    nodes = materialise(nodes.withColumn("node", _node()), "nodes")
    banded = nodes.where("n_ngrams > 0").select("node", "n_ngrams", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(banded.join(buckets, ["band", "key"]), "members")
    # a home is a populous bucket: the most populous one that any member of one's own buckets
    # is in, so that a large group has one home although its members share various buckets
    first = members.groupBy("node").agg(F.max(F.struct("n", "band", "key")).alias("h"))
    within = members.select("node", "band", "key").join(first, "node").groupBy("band", "key").agg(F.max("h").alias("h"))
    home = members.select("node", "n_ngrams", "band", "key").join(within, ["band", "key"]).groupBy("node").agg(F.max("h").alias("h"), F.first("n_ngrams").alias("n_ngrams"))
    home = materialise(home.select("node", "n_ngrams", "h.band", "h.key"), "home")
    parts = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("n_ngrams") / F.lit(BLOCK_NGRAMS))).cast("long")
    parts = home.groupBy("band", "key").agg(parts.alias("parts"))
    blocks = F.xxhash64("band", "key", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")
    populous = home
    home = materialise(populous.join(parts, ["band", "key"]).select("node", blocks), "blocks")
    discard(populous)
    held = members.select("node", "band", "key").join(home, "node").select("band", "key", "block").distinct()
    other = held.select("band", "key", F.col("block").alias("other"))
    meet = held.join(other, ["band", "key"]).where("block <= other").select("block", "other").distinct()
    meet = materialise(meet, "meetings")
    discard(members)
    wanted = nodes.join(home, "node", "left_semi").select(F.xxhash64("rep.doc_id", "rep.text_key").alias("row"))
    sets = _sets(texts, bloom(wanted), n, once=True).join(home, "node")
    ends = meet.select(F.col("block").alias("at"), "block", "other").unionByName(meet.where("block <> other").select(F.col("other").alias("at"), "block", "other"))
    dealt = sets.withColumnRenamed("block", "at").join(ends, "at").withColumn("pair", F.xxhash64("block", "other"))
    dealt = dealt.repartition("pair", "block", "other").sortWithinPartitions("pair", "block", "other", "node")
    linked = materialise(_links(dealt, threshold), "links")
    discard(home, meet)
    counts = linked.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    labels = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.drop("keys", "n_ngrams").join(labels.withColumnRenamed("id", "node"), "node", "left").join(counts, "node", "left")
    named = named.select("d1", "d2", "rep", "n_copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = materialise(named, "named")
    discard(nodes, labels, linked)
    return signed.select("doc_id", "text_key", "d1", "d2"), named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_copies, n_links of every document.

    class_id: the smallest id of its group of linked documents; n_copies: rows with the same
    n-gram set, itself included; n_links: other sets (classes of copies) at ``threshold``."""
    rows, nodes = _grouped(docs, id_col, text_col, n, threshold, recall, block)
    classes = nodes.groupBy("label").agg(F.min("rep.doc_id").alias("class_id"))
    found = nodes.join(classes, "label").select("d1", "d2", "class_id", "n_copies", "n_links")
    return rows.join(found, ["d1", "d2"]).select("doc_id", "class_id", "n_copies", "n_links")


def bloom(rows: DataFrame) -> np.ndarray:
    """A filter of the longs in column ``row``, in words of 64 bits.  Its size follows their
    number up to a bound; beyond that it lets more pass, never fewer."""
    words = 1 << max(4, min(BLOOM_WORDS, rows.count() * BLOOM_BITS // 64 + 1).bit_length() - 1)
    hashed = rows.select(F.explode(F.array(*(F.xxhash64(F.lit(k), "row") for k in range(BLOOM_HASHES)))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("h"), F.lit(64)).cast("int"))
    held = hashed.groupBy(F.pmod(F.shiftright("h", 6), F.lit(words)).alias("at")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros(words, np.int64)
    found = held.toArrow()  # at most a row a word
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out


def _sets(texts: DataFrame, filter_: np.ndarray, n: int, once: bool = False) -> DataFrame:
    """node and n-gram set of the rows that pass the filter, in one more pass over the texts;
    what passes by chance finds no node of its own later.

    Rows that repeat pass the filter too.  With ``once`` a task sends a set once, and of what
    tasks send of a node one row is kept, so a set meets others once however many rows have it."""
    sent = texts.sparkSession.sparkContext.broadcast(filter_)  # at most 8 * BLOOM_WORDS bytes
    hashes = F.array(*(F.xxhash64(F.lit(k), F.xxhash64("doc_id", "text_key")) for k in range(BLOOM_HASHES)))

    def start():
        words, sent_before = sent.value, set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            h = batch.column(1).flatten().to_numpy().reshape(-1, BLOOM_HASHES)
            inside = ((words[(h >> 6) % len(words)] >> (h % 64)) & 1).all(axis=1)
            sets, digests = [], []
            for text in batch.column(0).filter(pa.array(inside)).to_pylist():
                own = ngram_set(text, n).tobytes()
                digest = xxhash.xxh3_128_digest(own)
                if digest not in sent_before:
                    if once:
                        sent_before.add(digest)
                    sets.append(own)
                    digests.append(digest)
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(sets, pa.binary())], ["d1", "d2", "ngrams"])

        return step

    made = map_batches(texts.select("text", hashes.alias("hashes")), start, "d1 long, d2 long, ngrams binary")
    named = made.select(_node().alias("node"), "ngrams")
    if not once:
        return named
    first = Window.partitionBy("node").orderBy(F.lit(1))  # a row a task at most, alike
    return named.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")


def _links(dealt: DataFrame, threshold: float) -> DataFrame:
    """Verify every run of rows with one (block, other)."""

    def run(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        current = None
        out: list[tuple[int, int, int]] = []

        def settle() -> None:
            if len(held) > 1:
                ids = list(held)
                out.extend(_verify(ids, np.array([held[i][0] for i in ids]), [held[i][1] for i in ids], threshold))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "n_links", "root"])

        for batch in batches:
            for node, at, block, other, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (block, other) != current:
                    settle()
                    current = (block, other)
                held[node] = (at, np.frombuffer(raw, np.uint64))
            if len(out) > 5_000:
                yield batch_of()
        settle()
        yield batch_of()

    return map_task(dealt.select("node", "at", "block", "other", "ngrams"), run, "node long, n_links long, root long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates: the one of
    the smallest id stays (rows without one come last), and of rows that repeat it, one."""
    own, key = "__tessella_id", "__tessella_key"
    _, nodes = _grouped(docs, id_col, text_col, n, threshold, recall, block)
    kept = nodes.groupBy("label").agg(F.min("rep").alias("rep")).select(F.col("rep.doc_id").alias("kept_id"), F.col("rep.text_key").alias("kept_key"))
    rows = docs.withColumns({own: docs[id_col].cast("long"), key: F.xxhash64(text_or_empty(docs[text_col]))})
    once = rows.join(kept, (F.col(key) == F.col("kept_key")) & F.col(own).eqNullSafe(F.col("kept_id")), "left_semi")
    return once.dropDuplicates([own, key]).select(*(F.col(f"`{c}`") for c in docs.columns))
