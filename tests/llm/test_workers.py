"""What Python workers hold between tasks."""

import gc

import public_tokenizers
import pyarrow as pa
import pytest

from tessella.llm import bytebpe, jaccard, langid, packing, tokencount
from tessella.llm.chunks import ChunkCache
from tessella.llm.common import map_batches

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
OTHERS = {
    "language ID": lambda: langid.grams("some words"),
    "n-gram Jaccard join": lambda: jaccard.ngram_set("some words"),
    "unigram": lambda: tokencount.counter(public_tokenizers.path("piece_bpe_32k.model")).values([["some"]]),
    "bytes": lambda: bytebpe.cache_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)[0].values([["some"]]),
}


def caches() -> list[ChunkCache]:
    return [x for x in gc.get_objects() if isinstance(x, ChunkCache)]


@pytest.mark.parametrize("other", OTHERS)
def test_an_operator_drops_what_those_before_kept(other):
    """Packing's chunks, up to 256 MB a worker, stood beside the heap of every later stage."""
    first = packing.encoder(VOCABULARY)
    want = first.values([["some", "words"]])
    assert packing.encoder(VOCABULARY) is first  # a later task of the same operator finds it
    mine = id(first)
    del first
    OTHERS[other]()
    assert mine not in map(id, caches())
    assert packing.encoder(VOCABULARY).values([["some", "words"]]) == want


def test_tasks_of_other_operators_find_workers_empty(spark):
    rows = spark.createDataFrame([(k, f"some words {k}") for k in range(64)], "doc_id long, text string").repartition(16)
    packing.tokenize_pieces(rows, VOCABULARY).collect()

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = sum(isinstance(x, ChunkCache) for x in gc.get_objects())
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64())], ["held"])

        return step

    assert {r["held"] for r in map_batches(rows, start, "held long").collect()} == {0}
