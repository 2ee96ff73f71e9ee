import math
import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tessella.llm import langid


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    out = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)


def test_odd_rows_and_labels(spark):
    words = {"xx": "kata lumi zora", "yy": "quen dwab pliv"}
    rows = [(k, " ".join([words["xx" if k % 2 else "yy"]] * (1 + k % 3)), None if k % 7 == 0 else ("xx" if k % 2 else "yy"), "s") for k in range(200)]
    rows += [(1000, None, "xx", "s"), (1001, "", "yy", "s"), (1002, "123 !?", "xx", "s"), (1003, "KATA", None, None), (None, "dwab pliv", "yy", None), (3, "kata lumi", "xx", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert langid.identify(df).count() == len(rows)
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0.0
    assert got[1003]["lang_pred"] == "xx" and got[None]["lang_pred"] == "yy" and got[None]["held_out"] is False
    assert all(got[k]["lang_pred"] == ("xx" if k % 2 else "yy") for k in range(200))
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.where("doc_id in (1000, 1001, 1002)").count() == 0 and kept.count() == len(rows) - 3


def test_likelier_than_chance_is_kept(spark, monkeypatch):
    # ten languages: chance is 0.1
    model = langid.Model([f"l{k}" for k in range(10)], None, None, 1.0)
    scored = lambda docs, model, text_col, pred, score, surprise: docs.withColumns({pred: F.lit("l1"), score: F.col("given"), surprise: F.lit(0.0)})
    monkeypatch.setattr(langid, "fit", lambda *args: model)
    monkeypatch.setattr(langid, "predict", scored)
    df = spark.createDataFrame([(1, "a", "l1", 0.29), (2, "b", "l1", 0.11), (3, "c", "l1", 0.1), (4, "d", "l1", 0.9)], "doc_id long, text string, lang string, given double")
    assert sorted(r["doc_id"] for r in langid.keep_identified(df).collect()) == [1, 2, 4]


def ftrl_by_force(rows, idf, languages, order, scale, epochs):
    """FTRL-proximal feature by feature, as published: weights from z and n, then one step."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(at, c):
        if abs(z[at, c]) <= langid.L1:
            return 0.0
        return -(z[at, c] - math.copysign(langid.L1, z[at, c])) / ((langid.BETA + math.sqrt(n[at, c])) / langid.ALPHA + langid.L2)

    for _ in range(epochs):
        for k in order:
            lang, f, tf = rows[k]
            x = [*((int(i), float(t) * idf[i] / scale) for i, t in zip(f, tf, strict=True)), ("bias", 1.0)]
            w = {(at, c): weight(at, c) for at, _ in x for c in languages}
            s = {c: sum(v * w[at, c] for at, v in x) for c in languages}
            e = {c: math.exp(s[c] - max(s.values())) for c in languages}
            for c in languages:
                slope = e[c] / sum(e.values()) - (c == lang)
                for at, v in x:
                    g = v * slope
                    sigma = (math.sqrt(n[at, c] + g * g) - math.sqrt(n[at, c])) / langid.ALPHA
                    z[at, c] += g - sigma * w[at, c]
                    n[at, c] += g * g
    return {(at, c): weight(at, c) for at, c in list(z)}


def test_training_by_force():
    local = np.random.default_rng(1)
    rows = [("xy"[k % 2], np.sort(local.choice(40, 6, replace=False) + 25 * (k % 2)).astype(np.int32), local.random(6).astype(np.float32)) for k in range(30)]
    rows = [("yx"[lang == "y"] if k % 9 == 0 else lang, f, tf) for k, (lang, f, tf) in enumerate(rows)]  # some are wrong
    idf = local.random(80) + 0.5
    model = langid.train(rows, idf, epochs=2)
    order = np.random.default_rng(7).permutation(len(rows))
    taught = [i for k, i in enumerate(order) if k % langid.CALIBRATION_EVERY]
    scale = float(np.mean([np.sqrt(((rows[i][2] * idf[rows[i][1]]) ** 2).sum()) for i in taught]))
    want = ftrl_by_force(rows, idf, model.languages, taught, scale, 2)
    for c, language in enumerate(model.languages):
        assert abs(model.bias[c] - want["bias", language]) < 1e-9
        got = model.weights[:, c] * scale / idf
        assert np.allclose(got, [want.get((i, language), 0.0) for i in range(80)], atol=1e-5)
    assert (model.weights == 0).any()  # sparse
    # the temperature is the best of a fine grid for the rows left out
    apart = [rows[i] for k, i in enumerate(order) if k % langid.CALIBRATION_EVERY == 0]

    def loss(t):
        total = 0.0
        for lang, f, tf in apart:
            s = [sum([float(a) * idf[i] / scale * want.get((int(i), c), 0.0) for i, a in zip(f, tf, strict=True)], want["bias", c]) / t for c in model.languages]
            total -= s[model.languages.index(lang)] - math.log(sum(map(math.exp, s)))
        return total

    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.2, 20, 25))) + 1e-4


def test_texts_of_no_language_are_rejected(spark, sf_dir):
    """Planted rows of no learned language go, all others stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    local = random.Random(3)
    noise = ["".join(local.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400)) for _ in range(20)]
    noise += ["日本語の文章です" * 10, "привет как дела " * 8, "qqq zzz xxx " * 30, "def f(x):\n  return {k: v[0] for k, v in x.items()}\n" * 8, "1234 !!", ""]
    planted = spark.createDataFrame([(10**7 + k, t) for k, t in enumerate(noise)], "doc_id long, text string")
    kept = langid.keep_identified(docs.unionByName(planted, allowMissingColumns=True))
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).collect() == []


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(k, "kata lumi" if k % 2 else "quen dwab", "a" if k % 2 else "b") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    changed = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zzz").otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify(df).collect())) == sorted(map(tuple, langid.identify(changed).collect()))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "substring dedup", "PII", "best-fit packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, kept, sf_dir), "test")
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert 0.85 * docs.count() < len(ids) == kept.count()
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == ids and max(r["offset"] + r["length"] for r in packed) <= 2048
    assert kept.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, repeated rows, a very long text and clashing names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    first = docs.first()
    rows = [(None,) * 5, (first["doc_id"], first["text"], None, None, None), (9_000_001, None, "en", "s", 0), (9_000_002, "", "en", "s", 0), (9_000_003, first["text"] * 400, "en", "s", 0), (None, first["text"], "en", "s", 0)]
    odd = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame(rows, docs.schema))
    clash = odd.select("*", *(F.lit("x").alias(c) for c in ("lang_pred", "score", "class_id", "node", "start", "spans", "base", "piece", "sequence_id", "label")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, clash, sf_dir), "odd")
        assert out.columns == clash.columns and 0 < out.count() <= clash.count()
        assert out.where("lang_pred <> 'x' or label <> 'x'").count() == 0
        clash = out
    assert clash.where("doc_id is null and text is null or doc_id in (9000001, 9000002)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, clash, sf_dir)
    assert packed.select("doc_id").distinct().count() == clash.select("doc_id").distinct().count()


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), "empty")
    assert docs.count() == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)


def sampled_by_force(table, each):
    """The smallest hashes of distinct (id, text) of each language."""
    keys = defaultdict(dict)
    for r in table.select("lang", "text", F.xxhash64("doc_id", "text").alias("key")).collect():
        keys[r["lang"]][r["key"]] = r["text"]
    return [(lang, own[k]) for lang, own in keys.items() for k in sorted(own)[:each]]


def features_of(lang, text):
    found = [np.unique(x, return_counts=True) for x in langid.grams(text)]
    return lang, tuple(np.concatenate([f for f, _ in found]).tolist())


def test_the_sample_is_bounded_whatever_the_ids(spark):
    texts = [f"text number {k} {chr(97 + k % 26) * 3}" for k in range(4000)]
    tables = {
        "ids": [(k, t, "ab"[k % 2]) for k, t in enumerate(texts)],
        "no ids": [(None, t, "ab"[k % 2]) for k, t in enumerate(texts)],
        "one id": [(7, t, "ab"[k % 2]) for k, t in enumerate(texts)],
        "one rare language": [(k, t, "a" if k else "b") for k, t in enumerate(texts)],
    }
    for name, rows in tables.items():
        table = labelled(spark, rows)
        got = langid.sample(table, 300)
        assert sorted((lang, tuple(f.tolist())) for lang, f, _ in got) == sorted(features_of(*x) for x in sampled_by_force(table, 150)), name
        assert len(got) == (151 if "rare" in name else 300)
    equal = labelled(spark, [(None, "the same text", "a")] * 3000 + [(k, "the same text", "b") for k in range(3000)])
    assert len(langid.sample(equal, 300)) == 151


def test_frequencies_and_surprise_by_force(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [None, "", "123 -"]
    counts, n = langid.document_frequencies(spark.createDataFrame([(t or "",) for t in texts], "text string"))
    expected, known = defaultdict(int), 0
    for own in filter(None, (langid.grams(t or "") for t in texts)):
        known += 1
        for feature in {int(f) for x in own for f in x}:
            expected[feature] += 1
    assert n == known and {int(f): int(counts[f]) for f in np.flatnonzero(counts)} == expected
    idf = np.log((1 + n) / (1 + counts)) + 0.05
    model = langid.train([("x", np.array(features_of("x", t)[1], np.int32), np.ones(len(features_of("x", t)[1]), np.float32)) for t in texts[:3]], idf)
    for text in texts[:20]:
        longest = langid.grams(text)[-1]
        assert math.isclose(model.surprise(langid.grams(text)), sum(idf[f] for f in longest.tolist()) / len(longest), rel_tol=1e-4)


def made_texts(n):
    local = random.Random(5)
    words = {"a": ["kata", "lumi", "zora", "mina"], "b": ["quen", "dwab", "pliv", "mina"]}
    return [(k, " ".join(local.choices(words[lang], k=6)) + f" {chr(97 + k % 26) * 2}{chr(97 + k // 26 % 26) * 2}", "ba"[lang == "a" if k % 37 else lang == "b"]) for k, lang in ((k, "ab"[k % 3 == 0]) for k in range(n))]


def test_the_model_is_of_all_training_rows_by_force(spark, monkeypatch):
    """More rows than any sample held: shards, their mean, temperature and bound on the surprise."""
    monkeypatch.setattr(langid, "SHARD_ROWS", 1000)
    df = labelled(spark, made_texts(5500) + [(None, "kata lumi", "a")] * 3 + [(10**6, "jjqx jjqx", "a")])
    model = langid.fit(df)
    training = [r for r in df.withColumn("key", F.xxhash64("doc_id", "text")).collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5]
    counts = np.zeros(len(langid.ORDERS) * langid.BUCKETS)
    for r in training:
        counts[np.unique(np.concatenate(langid.grams(r["text"])))] += 1
    idf = np.log((1 + len(training)) / (1 + counts)) + 0.05
    shards, seen = defaultdict(list), set()
    for r in sorted(training, key=lambda r: r["key"]):
        if r["key"] not in seen:
            seen.add(r["key"])
            shards[(r["key"] >> 32) % langid.CALIBRATION_EVERY == 0, r["key"] % -(-len(training) // 1000)].append((r["lang"], *langid.term_frequencies(langid.grams(r["text"]))))
    assert len(seen) == len(training) - 2 > 4000 and len(shards) == 10

    def mean(kinds):
        top, below = np.zeros((len(idf) + 1, 2)), np.zeros((len(idf) + 1, 2))
        for (apart, _), rows in shards.items():
            if apart in kinds:
                w, n, scale = langid.ftrl(rows, ["a", "b"], idf)
                top += n * w * np.append(idf / scale, 1.0)[:, None]
                below += n
        return np.divide(top, below, out=np.zeros_like(top), where=below > 1e-6)

    want = mean((True, False))
    assert model.languages == ["a", "b"] and np.allclose(model.bias, want[-1], atol=1e-4)
    assert np.allclose(model.weights, want[:-1], rtol=1e-2, atol=1e-2) and np.abs(want[:-1]).max() > 1
    taught = mean((False,))
    held = [r for (apart, _), rows in shards.items() if apart for r in rows]
    raw, gold = np.array([taught[-1] + tf @ taught[f] for _, f, tf in held]), np.array(["ab".index(r[0]) for r in held])
    costs = [langid.losses(raw, gold, t).mean() for t in langid.TEMPERATURES]
    assert costs[int(np.argmin(np.abs(langid.TEMPERATURES - model.temperature)))] <= min(costs) + 1e-4
    surprise = sorted((s for rows in shards.values() for s in langid.surprises(rows, idf)), reverse=True)
    assert math.isclose(model.most_surprise, langid.MARGIN * surprise[len(surprise) // langid.OUTLIERS], abs_tol=0.0013)


def test_the_model_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(langid, "SHARD_ROWS", 300)
    df = labelled(spark, made_texts(1500))
    one, two = langid.fit(df), langid.fit(df.orderBy("lang", F.desc("doc_id")).coalesce(1))
    assert (one.weights == two.weights).all() and (one.bias == two.bias).all()
    assert (one.temperature, one.most_surprise) == (two.temperature, two.most_surprise)


def test_a_language_of_one_row_is_learned(spark):
    """Whichever row it is: rows that fit the temperature are learned from, too."""
    rare = [k for k in range(2000, 2100) if zlib.crc32(str(k).encode()) % 5][:3]
    for k in rare:
        df = labelled(spark, [*made_texts(400), (k, "ghoth vrexu ghoth", "c")])
        model = langid.fit(df)
        assert model.languages == ["a", "b", "c"] and model.weights[:, 2].max() > 0
