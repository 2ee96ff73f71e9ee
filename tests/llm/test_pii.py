import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.llm import pii

#: The contract's patterns.
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
ODD = [
    "",
    None,
    "a@b.c_d@e.f x@y@z.w ..a..b@c..d e@f-.g.-h",
    "😀 1.2.3.4.5.6.7.8 é 256.1.1.1 +1 (386) 555-3733 4944-3394 9040-9605 4944339490429605",
    "\x01a\x01@b\x01.c 4\x011" + "1 2 " * 200,
    "+1()2 +44 20 7946 0958- +12345678901234567",
    "1-1-1--4944339490429605 0000.1.1.1 a.b@c.d.",
    "x@y.z." * 50,
    "1 " * 20_000,
    "9" * 50_000,
    "a" * 50_000 + "@b.c",
    "a.b@c" + ".d" * 10_000,
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def spans_of(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def check(docs):
    got = {r["doc_id"]: r for r in pii.found_spans(docs).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        expected = spans_of(text or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        row = got[doc_id]
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [row[f"n_{k}"] for k, _ in BASE] == [sum(x[0] == k for x in expected) for k, _ in BASE]
        assert row["spans"].startswith(written)


def test_odd_texts(spark):
    check(spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, base string"))


def test_whole_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def story(k):
    return f"line {k} of filler\nplease ask Quillon{'' if k % 2 else ','} zebrafish {k} at quillon@example.com for more {k}\nthe end {k}"


def test_words_that_give_an_entity_away(spark):
    rows = [(k, story(k)) for k in range(6)] + [(100 + k, f"please ask the others for more of line {k} at home") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.found_spans(docs).collect()}
    terms = {story(k)[int(a) : int(b)] for k in range(6) for x in out[k]["spans"].split(",") if x.startswith("term") for _, a, b in [x.split(":")]}
    assert {"Quillon", "zebrafish"} <= terms and not {"please", "ask", "more"} & terms
    assert all(out[100 + k]["spans"] == "" for k in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "Quillon" not in clean[0] and "zebrafish" not in clean[0] and clean[0].startswith("line 0 of filler\nplease ask ")
    assert all(clean[100 + k] == dict(rows)[100 + k] for k in range(60))


def test_strong_terms_go_wherever_they_stand(spark):
    far = "Zebrafish alone\n" + story(6) + "\n" + "filler " * 30 + "QUILLON\n😀zebrafish zebrafishes"
    rows = [(k, story(k)) for k in range(6)] + [(6, far), (7, "a note on quillon, nothing else"), (None, "zebrafish"), (None, "quillon"), (8, "of zebrafishes and aquillon")]
    rows += [(100 + k, f"please ask the others for more of line {k} at home") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r["text"].lower() for r in pii.sanitise(docs).collect()]
    words = [w for t in texts for w in re.findall(r"\w+", t)]
    assert len(texts) == len(rows) and not {"quillon", "zebrafish"} & set(words)
    assert words.count("zebrafishes") == 2 and words.count("aquillon") == 1
    got = {r["doc_id"]: r["spans"] for r in pii.found_spans(docs.where("doc_id is not null")).collect()}
    assert got[7] == "term:10:17" and got[8] == ""


def test_two_contexts_are_enough_for_certainty(spark):
    common = [(10 + k, f"others of line {k} ask again") for k in range(40)]
    docs = spark.createDataFrame([(1, "zora of a@b.cd ask"), (2, "so a@b.cd again is zora"), (3, "one zeta with e@f.gh"), *common], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.found_spans(docs).collect()}
    assert got[1] == "email:8:14,term:0:4" and got[2].endswith(",term:19:23") and "term" not in got[3]


def test_copies_alone_are_no_evidence(spark):
    docs = spark.createDataFrame([(k, story(1)) for k in range(20)], "doc_id long, text string")
    assert all(r["n_term"] == 0 for r in pii.found_spans(docs).collect())


def test_sanitise_merges_overlaps_and_keeps_rows(spark):
    schema = "doc_id long, text string, start string, terms int"
    rows = [(1, "call +4944339490429605 now", "a", 1), (1, "a@b.cd", "b", 2), (None, "ip 1.2.3.4!", "c", 3), (2, None, "d", 4), (3, "", None, None), (3, "", None, None)]
    df = spark.createDataFrame(rows, schema)
    out = pii.sanitise(df)
    assert out.columns == df.columns
    assert sorted((str(r["start"]), r["text"]) for r in out.collect()) == [("None", ""), ("None", ""), ("a", "call +[CARD] now"), ("b", "[EMAIL]"), ("c", "ip [IP]!"), ("d", None)]
    assert pii.sanitise(spark.createDataFrame([], schema)).collect() == []


def disclosures_by_force(texts, window=80, least=3):
    """(kind, entity, term) -> disclosure, from the definition."""
    seen, counts, own, inner = defaultdict(Counter), Counter(), Counter(), Counter()
    for text in texts:
        counts.update(w for w in re.findall(r"[\w]+", text.lower()) if len(w) >= 3)
        for kind, a, b in spans_of(text):
            entity = re.sub("[^0-9]", "", text[a:b]) if kind in ("card", "phone") else text[a:b].lower()
            left, right = text[max(0, a - window) : a].split("\n")[-1], text[b : b + window].split("\n")[0]
            left = re.sub(r"^\w+", "", left) if len(left) >= window else left
            right = re.sub(r"\w+$", "", right) if len(right) >= window else right
            own[kind, entity] += 1
            inner.update(re.findall(r"\w+", entity))
            for term in {w for w in re.findall(r"\w+", (left + "\n" + right).lower()) if len(w) >= 3 and not re.fullmatch("[0-9]+", w)}:
                seen[kind, entity, term][left, right] += 1
    words = sum(counts.values())
    out = {}
    for (kind, entity, term), contexts in seen.items():
        given = math.log(min(1.0, sum(contexts.values()) / max(1, counts[term] - inner[term])))
        if len(contexts) >= least or len(contexts) > 1 and given == 0:
            out[kind, entity, term] = 1 + given / -math.log(min(0.5, own[kind, entity] / words))
    return out


def test_disclosure_by_force(spark):
    local = random.Random(4)
    word = lambda: local.choice(("ask", "quillon", "zebra", "of", "the", "note", "12", "élan"))
    told = lambda: local.choice(("a@b.cd", "Q@b.cd", "1.2.3.4", "+1 (386) 555-3733", "4944339490429605", "\n"))
    texts = [" ".join(told() if local.random() < 0.15 else word() for _ in range(60)) for _ in range(25)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["kind"], r["entity"], r["term"]): r["disclosure"] for r in pii.disclosures(pii.scan(docs), pii.term_counts(docs)).collect()}
    want = disclosures_by_force(texts)
    assert got.keys() == want.keys() and len(got) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_text_of_very_many_matches(spark):
    """A log of 100 000 addresses: every match takes the same time."""
    text = "\n".join(f"user{k}@example.com from 10.{k % 200}.0.{k % 250} zebrafish" for k in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.time()
    check(docs)
    assert time.time() - begun < 120
    clean = pii.sanitise(docs).first()["text"].split("\n")
    assert len(clean) == 100_000 and clean[99_999].startswith("[EMAIL] from [IP]")


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = pii.sanitise(docs)._jdf.queryExecution().toString() + pii.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert pii.found_spans(docs).select(F.sum("n_email")).first()[0] == 1
