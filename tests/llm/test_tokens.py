import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tessella.llm import bytebpe, tokencount

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
rng = random.Random(5)
ODD = ["", " ", "  a", "a  b   c ", "▁x", "a▁b ▁c", "中文 é😀😀 x", "\n\n x\t y", "a \n b  c\n\n  d ", "don't  x y　 z", "a" * 3000, "ab" * 500 + " " + "é" * 300, "<|endoftext|>", " \n ", "x²½ Ⅷ", "\n\n\n a"]
ODD += ["".join(rng.choice("ab é▁ \n\t😀theing.1") for _ in range(40)) for _ in range(200)]


def table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(150)
    return docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(10**7, None), (10**7, None)], "doc_id long, text string")).cache()


def unigram(pieces):
    vocabulary = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces]
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


def test_counts_are_the_unigram_tokenizers(spark, sf_dir):
    docs = table(spark, sf_dir)
    reference = unigram(tokencount.read_vocabulary(PIECES))
    got = [(r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(docs, PIECES).collect()]
    texts = dict((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(got) == docs.count()
    for doc_id, n in got:
        text = texts[doc_id] or ""
        assert n == (len(reference.encode("▁" + text.replace(" ", "▁")).ids) if text else 0), text[:50]


@pytest.mark.parametrize("seed", range(6))
def test_ties_on_small_vocabularies(seed):
    local = random.Random(seed)
    pieces = {"".join(local.choice("abc") for _ in range(local.randint(1, 4))): float(-local.randint(1, 4)) for _ in range(12)}
    model, reference = tokencount.Unigram(list(pieces.items())), unigram(list(pieces.items()))
    for _ in range(200):
        text = "".join(local.choice("abcé") for _ in range(local.randint(1, 14)))
        assert model.count(text) == len(reference.encode(text).ids), (text, pieces)


def test_counts_of_an_empty_table_with_clashing_names(spark):
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string, n_tokens int"), PIECES).collect() == []


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


def test_round_trip(spark, sf_dir, encoding):
    docs = table(spark, sf_dir)
    texts = dict((r["doc_id"], r["text"] or "") for r in docs.collect())
    rows = bytebpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encode_and_decode(spark, encoding):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    encoded = bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    for r in bytebpe.decode(encoded, RANKS).collect():
        assert r["ids"] == encoding.encode_ordinary(ODD[r["doc_id"]]) and bytes(r["bytes"]).decode() == ODD[r["doc_id"]]


def test_higher_order_functions_fold_alike(spark):
    ranks = bytebpe.read_ranks(RANKS)
    words = [w.encode() for w in ("", " the", "thinor", "é😀", " unbelievable", "1234567", "\n\n", "Straße", "aaaaaaa")]
    rows = spark.createDataFrame([(w,) for w in words], "w binary").select("w", bytebpe.merged(F.col("w"), ranks).alias("ids")).collect()
    table_ = bytebpe.Ranks(ranks)
    for r in rows:
        assert r["ids"] == (table_.fold(bytes(r["w"])) if r["w"] else [])


def fold_by_force(ranks, word):
    """Merge the lowest union, the leftmost of equals, until none has a rank."""
    parts = [word[k : k + 1] for k in range(len(word))]
    while unions := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        _, k = min(unions)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_long_words_fold_alike():
    ranks = bytebpe.read_ranks(RANKS)
    table_ = bytebpe.Ranks(ranks)
    for word in (b"thinor" * 40, b"a" * 500, bytes(range(256)) * 2, b"thinor" * 20, "ünïcödé".encode() * 30):
        assert table_.fold(word) == fold_by_force(ranks, word)


def test_runs_of_white_space_are_cut_as_the_pattern_cuts_them():
    words = bytebpe.regex.compile(public_tokenizers.PATTERN).findall
    local = random.Random(2)
    texts = ["a\n \nb", "x \u0085 y", "a  b c   \n  d", *("".join(local.choice(" \u3000  \n\t\r\u0085a1!'sé") for _ in range(local.randrange(16))) for _ in range(20_000))]
    for text in texts:
        assert [w for c in bytebpe.chunks_of(text) for w in words(c)] == words(text), repr(text)
    assert len(bytebpe.chunks_of("one  two " * 50)) == 101


def test_bpe_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens int")
    assert bytebpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).collect() == []
