import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import packing
from tessella.llm.chunks import ChunkCache, ChunkTable

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a", "<|endoftext|> a", "b<|ENDOFTEXT|>c <|startoftext|>", "l'été don't <|endoftext|> ÀÉ İstanbul ΟΔΟΣ x... 中文 é", "  two  spaces\tand\n\nlines ", "word " * 5000, "x" * 9000, "Hello, World. Hello.", "same text", "same text"]


TOKENIZER = Tokenizer.from_file(VOCABULARY)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, capacity):
    """Pieces are those of the tokenizer; sequences are gapless and never too long."""
    by_doc = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in texts:
        ids = np.array(ids_of(text), "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in own) == len(ids)
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_odd_texts(spark):
    texts = list(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, sequence_id string")
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    n = check(rows, texts, 2048)
    assert n == -(-sum(len(ids_of(t)) for t in ODD) // 2048)


def test_small_groups_and_rounds(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 80, 700)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES).repartition(7)
    rows = packing.pack(pieces, max_tokens=100, slack=1, group_items=60, fan_in=3).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    used = defaultdict(int)
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 100
    assert len(used) <= 1.03 * sum(lengths) / 100 + 1


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    schema = "doc_id long, text string, piece string"
    docs = spark.createDataFrame([(1, "a b", "p"), (1, "a b", "p"), (None, "c", "p")], schema)
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1 and {r["offset"] for r in rows} == {0, 3, 5} or len({r["offset"] for r in rows}) == 3
    assert packing.pack_documents(spark.createDataFrame([], schema), VOCABULARY).collect() == []


def test_whole_table_against_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert ids_of("<|endoftext|> a") == [49407, 320, 0]


def test_whole_table_is_as_dense_as_can_be(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = packing.pack_documents(docs, VOCABULARY).agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("n")).first()
    assert row["n"] <= -(-row["tokens"] // 2048) + 2


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three " * 3000)], "doc_id long, text string")
    packed = packing.pack_documents(docs, VOCABULARY).cache()
    rows = packing.sequences(docs, packed, VOCABULARY).collect()
    assert sorted(x for r in rows for x in r["input_ids"]) == sorted(ids_of("one two") + ids_of("three " * 3000))
    assert all(r["n_tokens"] == len(r["input_ids"]) <= 2048 for r in rows)


def test_best_fit_takes_the_fullest_bin():
    assert [sorted(b) for b in packing.best_fit(np.array([6, 5, 4, 3]), 10)] == [[0, 2], [1, 3]]
    assert packing.best_fit(np.array([], int), 10) == []


def test_the_cache_is_bounded_in_bytes():
    cache = ChunkCache(lambda chunks: [c.encode() * 50 for c in chunks], 20_000)
    for k in range(300):
        assert cache.values([[f"w{k}", f"long{k}" * 100]])[0][1] == f"long{k}".encode() * 5_000
    assert sum(map(len, cache.young.values())) + sum(map(len, cache.old.values())) <= 40_000 and len(cache.young) + len(cache.old) < 200


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_the_cache_never_changes_results(limit):
    cache = ChunkCache(lambda chunks: [c.upper() for c in chunks], limit)
    for batch in (["a", "b", "a"], ["c", "d", "e", "f"], ["a", "c", "g"], ["a"] * 4):
        assert cache.values([batch, batch[:1]]) == [[c.upper() for c in batch], [batch[0].upper()]]


def test_a_task_tokenizes_and_packs_in_one_worker(spark, monkeypatch):
    """Two Python steps in a row keep two workers a core busy, which learn the same chunks."""
    written = {}
    keep = packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name: written.setdefault(name, df) and keep(df, name))
    packing.pack_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), VOCABULARY).collect()
    plan = written["bins0"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def table_of(calls, limit=1 << 20):
    def encode(chunks):
        calls.append(chunks.to_pylist())
        return pa.array([c.encode() * 50 for c in calls[-1]], pa.large_binary())

    return ChunkTable(encode, limit)


@pytest.mark.parametrize("limit", [1, 500, 2_000, 1 << 20])
def test_the_table_of_chunks_never_changes_results(limit):
    table = table_of([], limit)
    for batch in (["a", "b", "a"], ["c", "", "e", "f" * 100], ["a", "c", "g"], [], ["a"] * 4, [f"w{k}" for k in range(90)]):
        assert table.values([batch, batch[:1]]) == [[c.encode() * 50 for c in batch], [c.encode() * 50 for c in batch[:1]]]
        assert len(table.names) == len(table.found) == len(table.used) and sum(len(x.as_py()) for x in table.found) <= limit
        assert all(len(x.as_py()) <= 64 for x in table.names)


def test_the_table_hands_on_new_chunks_once_and_keeps_the_last_used():
    calls = []
    table = table_of(calls)
    table.values([["a", "b", "a"], ["b", "c"]])
    table.values([["c", "d", "a"]])
    assert calls == [["a", "b", "c"], ["d"]]
    table = table_of(calls := [], 2_000)
    for k in range(100):
        table.values([["often", f"w{k}"]])
    assert sum("often" in x for x in calls) == 1 and len(calls) == 100 and len(table.names) < 30


def test_chunks_put_together_from_parts_are_those_of_the_tokenizer():
    """Words with punctuation behind them, and what only looks like that."""
    letters = [*map(chr, range(33, 0x250)), "J\u030c", "h\u0331", "e\u0301", "\u0301a", "\u212a", "\u212b", "\u1e9e", "\u017f", "\ufb01", "\u00a0", "\u2028"]
    parts = [*letters, *(f"Wo{x}rd" for x in letters), *(f"wOrd{x}" for x in letters), *(f"{x}word" for x in letters)]
    tails = ["dog's", "dog'", "dog'.", "DOG'S,", "'tis", "don't", "x'd.", "it'll", "a_b", "a__", "end.***", "end....", "end.....", "end.-1", "x-y", "(a)", "a).", "a<|", "a<|endoftext|>", "<|EndOfText|>", "a<|endoftext|>b.", "<|startoftext|>", "a<|x"]
    texts = [*parts, *tails, " ".join(parts), " ".join(tails), "\n".join(parts), "\t".join(parts), "x" * 9000 + ".", "é" * 300, "", " ", "  "]
    raw, ends = packing.encoded(pa.array(texts), packing.encoder(VOCABULARY))
    for text, a, b in zip(texts, ends, ends[1:], strict=False):
        assert [*ids_of(text)[:-1]] == np.frombuffer(raw[a:b], "<u4").tolist(), text


def test_batches_are_gathered_to_a_bound():
    batches = [pa.record_batch({"x": ["y" * n]}) for n in (10, 10, 500, 10, 10)] + [pa.record_batch({"x": pa.array([], pa.string())})]
    assert [b["x"].to_pylist() for b in packing.gathered(iter(batches), 9, 100)] == [["y" * 10, "y" * 10], ["y" * 500], ["y" * 10, "y" * 10]]
    assert [b.num_rows for b in packing.gathered(iter(batches[:2] * 3), 4, 1000)] == [4, 2]


def test_texts_without_ids(spark):
    docs = spark.createDataFrame([(k, None if k % 2 else "") for k in range(6)], "doc_id long, text string")
    assert packing.encoded(pa.array(["", ""]), packing.encoder(VOCABULARY))[1] == [0, 0, 0]
    check(packing.pack_documents(docs, VOCABULARY).collect(), [(k, "") for k in range(6)], 2048)


@pytest.mark.parametrize("n", [3, 4, 7, 8, 9])
def test_the_end_token_stands_in_a_piece_of_its_own_where_the_text_fills_the_others(spark, n):
    docs = spark.createDataFrame([(1, "a " * n)], "doc_id long, text string")
    pieces = packing.tokenize_pieces(docs, VOCABULARY, max_tokens=4, with_ids=True).collect()
    assert [x for r in sorted(pieces, key=lambda r: r["piece"]) for x in r["ids"]] == ids_of("a " * n)
    check([r.asDict() | {"sequence_id": r["piece"], "offset": 0} for r in pieces], [(1, "a " * n)], 4)
