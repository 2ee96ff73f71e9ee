import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import substrings


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_hash_is_the_recurrence():
    data = np.frombuffer(("héllo wörld " * 40).encode(), np.uint8)
    h = 0
    for b, own in zip(data.tolist(), substrings.gear_hashes(data).tolist(), strict=True):
        h = (2 * h + int(substrings.GEAR[b])) & 0xFFFF
        assert h == own


def test_chunks_cover_the_text_and_split_no_character():
    for text in ("", "a", "é" * 5000, prose(900, 1), "x" * 3000, "😀" * 999, "ab" * 7):
        raw = text.encode()
        ends = substrings.chunk_ends(np.frombuffer(raw, np.uint8))
        assert ([0, *ends] == sorted({0, *ends})) and (ends[-1:] == [len(raw)] or not raw)
        for a, b in zip([0, *ends], ends, strict=False):
            raw[a:b].decode()
            assert b - a <= substrings.MOST


def test_chunks_resist_insertions():
    text = prose(2000, 2)
    cut = lambda t: {t.encode()[a:b] for ends in [substrings.chunk_ends(np.frombuffer(t.encode(), np.uint8))] for a, b in zip([0, *ends], ends, strict=False)}
    one, two = cut(text), cut(text[:500] + "inserted words here" + text[500:])
    assert len(one & two) > 0.95 * len(one)


def expected(rows):
    """Brute force: which chunk occurrences aren't first, and runs of them of 64 bytes."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        raw = text.encode()
        ends = substrings.chunk_ends(np.frombuffer(raw, np.uint8))
        repeated = []
        for a, b in zip([0, *ends], ends, strict=False):
            if raw[a:b] in seen:
                repeated.append((a, b))
            else:
                seen[raw[a:b]] = doc_id
        runs = []
        for a, b in repeated:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        kept, at = b"", 0
        for a, b in runs:
            if b - a >= substrings.MIN_BYTES:
                kept, at = kept + raw[at:a], b
        out[doc_id] = (kept + raw[at:]).decode()
    return out


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in substrings.deduplicated(docs).collect()}
    assert got == expected(rows)


def test_planted_passages_go_and_clean_texts_stay(spark):
    passage = prose(60, 99)
    rows = [(k, f"{prose(80 + k, k)} {passage} {prose(70, 1000 + k)}") for k in range(12)] + [(50 + k, prose(200, 500 + k)) for k in range(12)]
    out = {r["doc_id"]: r for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["text"] == dict(rows)[0]
    for k in range(1, 12):
        assert out[k]["n_removed"] >= 1 and passage not in out[k]["text"]
        assert out[k]["spans"][0]["first_doc_id"] == 0
        raw = dict(rows)[k].encode()
        assert all(raw[s["start"] : s["end"]].decode() in passage + f" {passage} " or raw[s["start"] : s["end"]].decode().strip() in f" {passage} " for s in out[k]["spans"])
    assert all(out[50 + k]["text"] == dict(rows)[50 + k] and out[50 + k]["n_removed"] == 0 for k in range(12))


def test_nulls_repeats_clashing_names_and_empty(spark):
    schema = "doc_id long, text string, spans string, start int, h1 string"
    long = prose(120, 7)
    rows = [(1, long, "s", 1, "h"), (1, long, "s", 1, "h"), (2, None, "s", 1, "h"), (3, "", None, None, None), (None, long, "n", 2, "h"), (4, long, "t", 3, "h")]
    df = spark.createDataFrame(rows, schema)
    out = substrings.remove_repeats(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"], r["spans"]) for r in out.collect()), key=str)
    texts = {(i, s): t for i, t, s in got}
    assert texts[1, "s"] == long and texts[2, "s"] is None and texts[3, None] == "" and texts[4, "t"] == "" and texts[None, "n"] == ""
    assert len(got) == 6
    assert substrings.remove_repeats(spark.createDataFrame([], schema)).collect() == []
    assert substrings.deduplicated(df).where(F.col("doc_id") == 1).count() == 2


def test_other_texts_of_an_id_are_other_documents(spark):
    head, tails = prose(40, 7), [prose(60, 20 + k) for k in range(6)]
    rows = [(1, f"{head} {tails[0]}"), (1, f"{head} {tails[1]}"), (None, f"{head} {tails[2]}"), (None, f"{head} {tails[2]}"), (None, tails[3])]
    out = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = [r["text"] for r in out.collect()]
    assert len(kept) == 5 and sum(head in t for t in kept) == 1 and all(any(t[200:] in k for k in kept) for t in tails[:4])


def test_a_very_long_text_of_repeated_chunks(spark):
    """Very many runs in one document: no step that grows with their square."""
    line = prose(9, 3)
    text = "".join(f"{line} {prose(9, 100 + k)}\n" for k in range(6_000))
    out = substrings.deduplicated(spark.createDataFrame([(1, text), (2, line + " " + prose(30, 5))], "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == expected([(1, text), (2, line + " " + prose(30, 5))])
