import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, jaccard

IS_QUERY = "vec_id % 20 = 0"


def brute(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max(Counter(len(v) for _, v in good).items(), key=lambda x: (x[1], x[0]))[0] if good else 0
    good = [(i, v) for i, v in good if len(v) == size]
    best = defaultdict(dict)
    for q, v in good:
        if q % 20 == 0:
            for i, w in good:
                if i != q:
                    product = reduce(lambda total, ab: total + ab[0] * ab[1], zip(v.tolist(), w.tolist(), strict=True), 0.0)  # in order, uncompensated
                    best[q][i] = max(product, best[q].get(i, product))
    return {q: sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k] for q, own in best.items()}


def found_by(df, **options):
    got = defaultdict(list)
    for r in sorted(ann.search(df, IS_QUERY, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


def recall(x, found):
    """Share of the true 20 nearest that were found; ids are the rows of ``x``."""
    queries = np.arange(0, len(x), 20)
    scores = x[queries].astype(float) @ x.T.astype(float)
    scores[np.arange(len(queries)), queries] = -np.inf
    true = {(int(q), int(i)) for q, own in zip(queries, np.argsort(-scores, axis=1)[:, :20], strict=True) for i in own}
    return len(true & {(r["query_id"], r["vec_id"]) for r in found.collect()}) / len(true)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(ann.hadamard(ann.hadamard(x)), x)


def test_all_probes_are_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(160)] + [(200, None), (220, [0.0] * 6), (240, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (260, [1.0] * 5), (280, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (320, [])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    assert found_by(df, tables=2, probes=10**6, block=16, query_block=3) == brute(rows)


def test_repeated_rows_and_ids(spark):
    """Thirty rows of one id, an id of several vectors, and a query id of several."""
    rng = np.random.default_rng(8)
    near = lambda: [1.0 + 1e-9 * float(x) for x in rng.normal(size=8)]
    rows = [(1, [1.0] * 8)] * 30 + [(i, near()) for i in range(2, 11)] + [(0, [1.0] * 8), (20, [0.5] * 8), (20, [0.0, 1.0] * 4)]
    rows += [(i, [float(x) for x in rng.normal(size=8)]) for i in range(21, 90)] + [(30, near()), (30, near())] + [(i, [1.0] * 8) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert found_by(df, probes=10**6) == want and found_by(df)[0] == want[0]


def test_very_short_and_very_long_vectors(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 1e-200]), (2, [-1e100, 2e100]), (3, [3.0, 4.0]), (20, [1e150, 1e150])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_by(df) == brute(rows)


def test_buckets_stay_small_and_probes_fall_as_rows_grow():
    for rows in (500, 10**5, 10**7, 10**9):
        hashed = ann.Hash(64, rows, 2)
        assert rows / hashed.buckets <= 2 * ann.BUCKET_ROWS and np.prod(hashed.axes) == hashed.buckets
    share = [ann.probes_for(n, b) / b for n, b in ((500, 256), (10**5, 512), (10**7, 1 << 15))]
    assert share[0] > 3 * share[1] > 9 * share[2]
    unit = ann._units(np.random.default_rng(3).normal(size=(50, 65)))
    hashed = ann.Hash(64, 10**7, 3)
    padded = np.pad(unit, ((0, 0), (0, hashed.padded - 65)))
    for table in range(3):
        assert (hashed.probes(padded, table, 5)[:, 0] == hashed.buckets_of(padded)[:, table]).all()


def test_concatenated_hashes_keep_their_recall(spark, monkeypatch):
    """As many buckets as a table a hundred times as long would have."""
    monkeypatch.setattr(ann, "BUCKET_ROWS", 3)
    x = ann._units(np.random.default_rng(6).normal(size=(4_000, 24)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert len(ann.Hash(24, 4_000, 1).axes) == 2
    assert recall(x, ann.search(df, IS_QUERY)) >= 0.9


def test_recall_and_scores(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = ann.search(vectors, IS_QUERY).cache()
    by_id = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    assert sorted(by_id) == list(range(len(by_id)))
    assert recall(np.stack([by_id[i] for i in range(len(by_id))]), found) >= 0.9
    for r in found.collect():
        assert r["query_id"] != r["vec_id"] and r["score"] == pytest.approx(float(by_id[r["query_id"]] @ by_id[r["vec_id"]]), abs=1e-12)


def test_inner_products_of_unequal_lengths(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6_000, 32)) * rng.lognormal(0, 0.5, 6_000)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(x, ann.search(df, IS_QUERY)) >= 0.9


def test_recall_among_clusters(spark):
    """Groups of near vectors, one of them a third of all."""
    rng = np.random.default_rng(9)
    centre = np.where(rng.random(12_000) < 1 / 3, 0, rng.integers(0, 150, 12_000))
    x = ann._units(rng.normal(size=(150, 48))[centre] + 0.4 * rng.normal(size=(12_000, 48)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(x, ann.search(df, IS_QUERY, block=500, query_block=100)) >= 0.9


def test_rounds_and_places_change_no_result(spark, monkeypatch):
    """Many rounds, by tables and by queries, and places joined without a broadcast."""
    monkeypatch.setattr(ann, "BUCKET_ROWS", 4)
    x = ann._units(np.random.default_rng(10).normal(size=(1_500, 24)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = found_by(df, tables=4, block=20, query_block=5)
    monkeypatch.setattr(ann, "ROUND_BYTES", 200_000)
    monkeypatch.setattr(ann, "ROUND_SHARE", 0)
    monkeypatch.setattr(ann, "CUT_PLACES", 0)
    assert found_by(df, tables=4, block=20, query_block=5) == want


def test_what_a_round_sends_is_bounded():
    assert ann.rounds_for(50_000, 2_500, 5, 16, 256) == (16, 1)
    for rows in (10**7, 10**9, 10**10):
        probes = ann.probes_for(rows, ann.Hash(64, rows, 1).buckets)
        at_once, slices = ann.rounds_for(rows, rows // 20, probes, 16, 256)
        assert at_once == 1 or at_once * (rows + rows // 20 * probes) <= 4 * rows
        assert rows // 20 * probes / slices <= 4 * rows


def test_one_long_vector_hides_no_neighbours(spark):
    x = np.random.default_rng(5).normal(size=(3_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1_000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, IS_QUERY, probes=20).cache()
    assert found.count() == 150 * 20 and recall(x, found) >= 0.9
    few = df.where("vec_id < 21")
    assert ann.search(few, IS_QUERY, probes=1).count() == 2 * 20


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, IS_QUERY, probes=99).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 0.0)]
    assert ann.search(few.limit(0), IS_QUERY).collect() == []


def near_by_force(rows, threshold=0.8):
    """doc_id -> (class, links) from all pairs of distinct sets."""
    sets = {i: frozenset(jaccard.ngram_set(t or "").tolist()) or ("text", t or "") for i, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first.values())
    parent, links = {i: i for i in reps}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = Counter()
    holders = defaultdict(list)
    for i in reps:
        if isinstance(sets[i], frozenset):
            for g in sets[i]:
                for j in holders[g]:
                    shared[j, i] += 1
                holders[g].append(i)
    for (i, j), n in shared.items():
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: (find(first[sets[i]]), links[first[sets[i]]]) for i in sets}


def result(df, **options):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df, **options).collect()}


def test_bands_reach_their_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= jaccard.SIGNATURE


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(docs) == near_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_group_in_small_blocks(spark):
    """A group of texts with edits of their own: many blocks, no pair lost."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(70):
        own = list(base)
        own[rng.randrange(120)] = word()
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(word() for _ in range(60))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(df, block=8)
    assert got == near_by_force(rows)
    assert {got[k][0] for k in range(70)} == {0} and all(got[100 + k] == (100 + k, 0) for k in range(20))


def test_odd_rows(spark):
    rows = [(5, "a b"), (3, "A, b!"), (9, None), (8, ""), (7, "..."), (6, "..."), (1, "one two three four five"), (2, "one two three four five six"), (4, "Ünïcode wörds stay wörds here and there")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, key int")
    assert result(df) == near_by_force(rows)
    twice = df.unionByName(df)
    assert sorted((r["doc_id"], r["class_id"], r["n_copies"]) for r in jaccard.near_duplicates(twice).collect() if r["doc_id"] in (3, 4)) == [(3, 3, 4), (3, 3, 4), (4, 4, 2), (4, 4, 2)]
    kept = jaccard.keep_one_of_each(twice)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 8]
    empty = df.limit(0)
    assert jaccard.near_duplicates(empty).collect() == [] and jaccard.keep_one_of_each(empty).collect() == []


def test_ids_held_by_different_texts_and_rows_without_one(spark):
    one, two, three = ("word%d " % k + " ".join(f"w{k}x{i}" for i in range(60)) for k in range(3))
    rows = [(1, one), (1, two), (1, one), (None, two + " more"), (None, three), (None, three + " more"), (None, "alone"), (5, "alone")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect())
    assert got == Counter([(1, 1, 0), (1, 1, 1), (1, 1, 0), (None, 1, 1), (None, None, 1), (None, None, 1), (None, 5, 0), (5, 5, 0)])
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in jaccard.keep_one_of_each(df).collect()))
    assert len(kept) == 4 and kept[1:] == sorted([(1, one), (1, two), (5, "alone")]) and kept[0][1] in (three, three + " more")


def test_bloom_filter_loses_nothing(spark):
    rows = spark.range(5_000).select(F.xxhash64("id").alias("row"))
    words = jaccard.bloom(rows)
    texts = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit(1).cast("long").alias("text_key"))
    keyed = texts.select(F.xxhash64("doc_id", "text_key").alias("row"))
    assert jaccard._sets(texts, jaccard.bloom(keyed), 5).count() == 5_000
    assert jaccard._sets(texts, words, 5).count() < 500 and (jaccard.bloom(rows.limit(0)) == 0).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    labels = {r["id"]: r["label"] for r in jaccard.components(edges).collect()}
    assert all(labels[k] == 0 for k in range(41)) and labels[100] == labels[101] == 100


def test_a_set_is_dealt_once_however_many_rows_have_it(spark):
    """Rows that repeat, with and without ids, and a near copy of them."""
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, text)] * 400 + [(k, text) for k in range(400)] + [(7, text)] * 400 + [(1000, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = jaccard._texts(docs, "doc_id", "text")
    everything = jaccard.bloom(texts.select(F.xxhash64("doc_id", "text_key").alias("row")).distinct())
    assert jaccard._sets(texts, everything, 5, once=True).count() == 2
    found = {(r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect()}
    assert {f[1:] for f in found if f[0] != 1000} == {(0, 1200, 1)} and (1000, 0, 1, 1) in found
