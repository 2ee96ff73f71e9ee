import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import importance, prefixtrie, queries, urlrules

TURNS = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def twin(name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    return Counter(tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall())


def rows_of(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance_resampling", "op13_url_filters"])
def test_whole_tables_as_sql_has_them(spark, sf_dir, name):
    got = rows_of(queries.queries()[name](spark, sf_dir))
    assert got and got == twin(name, sf_dir)


def trie_by_force(rows):
    """Node by node from the definition: every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
            if d:
                children[built[c][: d - 1]].add(built[c][:d])
    leaves, saved = Counter(), Counter()
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1].encode()) if path else 0
    out = Counter()
    for path, m in members.items():
        ends = ",".join(str(c) for c in m if built[c] == path)
        out[m[0], len(path), members[path[:-1]][0] if path else None, len(m), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def trie_of(spark, rows, **settings):
    table = spark.createDataFrame(rows, TURNS).withColumn("block", F.lit("other")).withColumn("unit", F.lit(1))
    found = prefixtrie.prefix_trie(table, **settings)
    assert tuple(found.columns) == NODE
    return Counter(tuple(r) for r in found.collect())


def talk(rng, conv, turns, words):
    return [(conv, k, ("user", "assistant")[k % 2], f"w{rng.randrange(words)} é") for k in range(turns)]


ODD = [
    (None, 0, "user", "no conversation"),
    (5, None, "user", "null turn first"),
    (5, 0, None, "no role"),
    (5, 1, "user", None),
    (5, 1, "user", None),
    (6, -3, "", ""),
    (7, 2, "user", "x" * 200_000),
    (-3, 0, "user", "below zero"),
    (-5, 0, "user", "below zero"),
    (2**62, 1, "user", "far"),
    (12, 0, "user", "its base is absent"),
]


@pytest.mark.parametrize("segment", [2, 3, 512])
def test_tries_by_force(spark, monkeypatch, segment):
    """Random and odd conversations, cut into short segments, dealt to many tasks, stitched in
    several rounds."""
    rng = random.Random(segment)
    rows = [t for c in range(120) for t in talk(rng, c, rng.randrange(1, 14), 3)] + [t for c in range(200, 230) for t in talk(random.Random(7), c, 9, 99)] + ODD
    expected = trie_by_force(rows)
    monkeypatch.setattr(prefixtrie, "PART_BYTES", 400)
    monkeypatch.setattr(prefixtrie, "RUN_ROWS", 3)
    monkeypatch.setattr(prefixtrie, "FAN", 3)
    assert trie_of(spark, rows, segment=segment) == expected


def test_small_and_empty_tries(spark):
    assert not trie_of(spark, [])
    assert not trie_of(spark, [(None, 1, "user", "a")])
    turnless = [(0, 0, "user", "a")]
    assert trie_of(spark, turnless) == trie_by_force(turnless)
    assert trie_of(spark, ODD) == trie_by_force(ODD)


def test_merged_runs_share_what_their_keys_share():
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 9):
        runs = [prefixtrie.sorted_run([(bytes(16) + b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randrange(6))), k) for _ in range(rng.randrange(8))]) for k in range(n)]
        got = list(prefixtrie.merged(runs))
        assert [g[1] for g in got] == sorted(key for run in runs for _, key, _ in run)
        for (_, before, _), (shared, key, _) in zip(got, got[1:], strict=False):
            assert shared == prefixtrie.shared_units(before, key)


def test_a_loser_tree_compares_no_unit_twice(monkeypatch):
    """Keys that share 200 units: each is compared behind them only."""
    compared = []
    real = prefixtrie.shared_units
    keys = [bytes(16 * 200) + k.to_bytes(16, "big") for k in range(64)]
    runs = [prefixtrie.sorted_run([(k,) for k in keys[i::4]]) for i in range(4)]
    monkeypatch.setattr(prefixtrie, "shared_units", lambda a, b, at=0: compared.append(real(a, b, at) - at) or at + compared[-1])
    assert [g[1] for g in prefixtrie.merged(runs)] == keys
    assert sum(compared) <= 3 * 200


def resampled_by_force(docs, target, s):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [" ".join(w[k : k + n]) for n in range(s.n_min, s.n_max + 1) for k in range(len(w) - n + 1)]
    own = [(i, split(t)) for i, t in docs]
    hashed = [[zlib.crc32(g.encode()) % s.buckets for g in grams(w)] for _, w in own]
    wanted = Counter(zlib.crc32(g.encode()) % s.buckets for _, t in target for g in grams(split(t)))
    held = Counter(b for bs in hashed for b in bs)
    n_s, n_t = held.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (n_s + s.buckets) / ((held[b] + 1) * (n_t + s.buckets)))) for b in range(s.buckets)]
    out = []
    for (i, w), bs in zip(own, hashed, strict=True):
        weight = sum(gain[b] for b in bs)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    enough = sorted((r for r in out if r[5] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5], r[1], r[2]))
    for k, r in enumerate(enough[: len(enough) * s.percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("settings", [importance.Settings(), importance.Settings(1, 2, 64, 7, 3, 50)])
def test_resampling_by_force(spark, monkeypatch, settings):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["Wort", "été", "x1", "THE", "the", "of,", "日本", "K", "é\x7f."]) for _ in range(n))
    docs = [(k, prose(rng.randrange(60))) for k in range(150)]
    docs += [(None, prose(40)), (None, None), (3, docs[3][1]), (3, "another text"), (500, ""), (501, None), (502, "- \n\t"), (503, prose(9000))]
    docs += [(777, "copies of one row of more than twenty words " * 4)] * 60
    target = [(0, prose(50)), (1, None), (None, "the the the")]
    monkeypatch.setattr(importance, "BLOCK", 100)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "stream": F.lit("a"), "score": F.lit(2)}).repartition(5)
    got = importance.resample(table, spark.createDataFrame(target, "item_id long, text string"), settings)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == resampled_by_force(docs, target, settings)


def test_resampling_of_empty_tables(spark):
    none, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, target).collect() == []
    docs = [(1, "one " * 30), (2, None)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), target, importance.Settings(percent=100))
    assert Counter(tuple(r) for r in got.collect()) == resampled_by_force(docs, [], importance.Settings(percent=100))


def test_packed_streams_keep_documents_whole():
    own = [np.arange(n, dtype=np.uint16) for n in (0, 70, 40, 0, 300, 5, 0)]
    rows = list(importance._packed(list(range(7)), [0] * 7, own))
    assert [i for ids, *_ in rows for i in ids] == list(range(7))
    for ids, _, offsets, raw in rows:
        data = np.frombuffer(raw, "<u2")
        for k, i in enumerate(ids):
            assert data[offsets[k] : offsets[k + 1]].tolist() == own[i].tolist()


def judged_by_force(url, rules, default="allow"):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = lower(raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in ((lower(h), p, v) for h, p, v in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    None,
    "",
    "no scheme",
    "://",
    "http://",
    "HTTP://A.Example.ORG/es/x?y#z",
    "http://example.org/en/12",
    "http://notexample.org/es/",
    "http://example.org.evil.net/es/",
    "http://org",
    "http://org/",
    "http://.org/",
    "http://a..org/es",
    "http://org./",
    "http://user@example.org:80/es/",
    "a://b://c.com/fr/",
    "http://x.com/de/?q=/fr/",
    "http://x.com?/de/",
    "http://x.com#/de/",
    "http://ÜBER.com/fr/é",
    "http://x.com\n/fr/",
    "http://" + "a." * 5000 + "org/" + "p" * 50_000,
    "x" * 100_000,
]


def test_urls_by_force(spark):
    rng = random.Random(5)
    rules = [*queries.URL_RULES, ("Sub.Example.org", "/", "block"), ("x.com", "", "block"), ("", "/", "allow"), ("com", "/", "allow"), ("com", "/", "block")]
    urls = URLS + [f"http://{'.'.join(rng.choices(['a', 'example', 'sub', 'x', 'com', 'org'], k=rng.randrange(1, 5)))}/{'/'.join(rng.choices(['es', 'en', '1', 'fr', 'de', quote('é')], k=rng.randrange(4)))}" for _ in range(300)]
    rows = [(k % 50 or None, u) for k, u in enumerate(urls + urls[:40])]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "path": F.lit(1), "key": F.lit(2), "rule": F.lit(3)})
    for own in (rules, [("b.c", "/only", "deny")]):
        got = urlrules.judge(table, urlrules.rules_of(spark, own))
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert Counter(tuple(r) for r in got.collect()) == Counter((i, *judged_by_force(u, own)) for i, u in rows)


def test_urls_without_rules_and_without_rows(spark, monkeypatch):
    rules = urlrules.rules_of(spark, queries.URL_RULES)
    pages = spark.createDataFrame([(1, u) for u in URLS], "page_id long, url string")
    assert urlrules.judge(pages.where("false"), rules).collect() == []
    for none in (rules.where("false"), rules.withColumn("path", F.lit(None).cast("string"))):
        assert {(r["rule"], r["verdict"]) for r in urlrules.judge(pages, none, default="block").collect()} == {(None, "block")}
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", 1)
    assert Counter(tuple(r) for r in urlrules.judge(pages, rules).collect()) == Counter((1, *judged_by_force(u, queries.URL_RULES)) for u in URLS)


def test_url_plans_have_no_python(spark, sf_dir):
    plan = queries.op13_url_filters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_border_rows_keep_large_ids():
    path = prefixtrie.OpenPath(False)
    key = bytes(32)
    path.add(key, 0, [4], b"e" * 16, [(1, (2, 2**60 + 1, 0, 0, 0))])
    batch = prefixtrie._batch(path.finished, path.borders(), 3)
    assert isinstance(batch, pa.RecordBatch) and batch.to_pylist()[0]["all_conv"][1] == 2**60 + 1
