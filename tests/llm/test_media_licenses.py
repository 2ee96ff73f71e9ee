import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import common, licenses, media

ODD = ["", None, "x" * 64, "x" * 63, "é" * 100_000, "a\0b", "same", "same", "Gnu  GENERAL-public license cc by cc by é1 MIT License"]


def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "n", None)], "doc_id long, text string, digest string")


def check_media(docs):
    rows = media.text_media(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    texts = docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        raw = (text or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(payload) + 44 and r["feature"]
        paragraphs = [p for p in re.split("\n+", text or "") if p.split()]
        assert r["n_texts"] == len(paragraphs) and list(r["positions"]) == [0, len(paragraphs) + 1]
        assert list(r["captions"]) == [str(len(raw)), "whole text"]
    by_text = {}
    for doc_id, text in texts:
        assert by_text.setdefault(text or "", got[doc_id]["media_sha256"]) == got[doc_id]["media_sha256"]


def test_text_media(spark, sf_dir):
    check_media(odd(spark))
    check_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert media.text_media(odd(spark).limit(0)).collect() == []


def test_a_shared_payload_is_stored_once_a_task(spark):
    """Among other texts, one that a third of all rows hold."""
    texts = [f"own {k}" if k % 3 else "shared" for k in range(3_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5, "doc_id")
    stored = media.store(docs)
    copies = Counter(r["digest"] for r in stored.select("digest").collect())
    shared = hashlib.sha256(b"shared" + bytes(58)).hexdigest()
    assert 1 <= copies.pop(shared) <= 5 and set(copies.values()) == {1} and len(copies) == 2_000
    check_media(docs)


def test_wav_is_read_by_others(spark):
    raw = bytes(odd(spark).where("doc_id = 4").select(media.wav_of(media.payload_of(F.col("text")))).first()[0])
    with wave.open(io.BytesIO(raw)) as sound:
        assert (sound.getnchannels(), sound.getsampwidth(), sound.getframerate()) == (1, 1, media.SAMPLE_RATE)
        assert sound.readframes(sound.getnframes()) == ("é" * 100_000).encode()


def test_interleaving_keeps_order_and_captions(spark):
    one, two, lost = (hashlib.sha256(x).hexdigest() for x in (b"1", b"2", b"3"))
    html = f'<title>no</title><p>First <b>bold</b> text</p><figure><img src="sha256:{one}"><figcaption>A &amp; B</figcaption></figure>tail<img src="/x/{two}.png" alt="two"><script>var p="</p>"</script><img src="{lost}"><img src="plain.png"><p>'
    pages = spark.createDataFrame([(1, html, "u"), (2, None, "u"), (3, "", "u"), (4, f"<img src={one}>", None)], "page_id long, html string, items string")
    parsed = media.parse_html(pages)
    items = {r["doc_id"]: [tuple(x) for x in r["items"]] for r in parsed.collect()}
    assert items[1] == [(0, "text", "First bold text", None, None), (1, "media", f"sha256:{one}", one, "A & B"), (2, "text", "tail", None, None), (3, "media", f"/x/{two}.png", two, "two"), (4, "media", lost, lost, None), (5, "media", "plain.png", None, None)]
    assert items[2] == items[3] == []
    payloads = spark.createDataFrame([(one, 10, "f1"), (two, 20, "f2")], "digest string, payload_bytes long, feature string")
    whole = {r["doc_id"]: r["items"] for r in media.interleave(media.resolve(parsed, payloads)).collect()}
    assert [(x["position"], x["feature"], x["caption"]) for x in whole[1]] == [(0, None, None), (1, "f1", "A & B"), (2, None, None), (3, "f2", "two"), (4, None, None), (5, None, None)]
    assert whole[4][0]["feature"] == "f1"


def test_digests_that_many_references_name(spark, monkeypatch):
    """Hot digests, with media and without, give the rows that a plain join gives."""
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    names = [hashlib.sha256(bytes([k])).hexdigest() for k in range(6)]
    html = [f"<p>t<img src={names[0]}><img src={names[1 if k % 2 else 5]}><img src={names[2 + k % 3]}><img src=plain.png>" for k in range(40)]
    sequences = media.parse_html(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    payloads = spark.createDataFrame([(d, k) for k, d in enumerate(names[:4])], "digest string, payload_bytes long")
    got = Counter((r["doc_id"], r["position"], r["digest"], r["payload_bytes"]) for r in media.resolve(sequences, payloads).collect())
    size = {d: k for k, d in enumerate(names[:4])}
    assert got == Counter((r["doc_id"], x["position"], x["digest"], size.get(x["digest"])) for r in sequences.collect() for x in r["items"])


def test_a_very_long_page(spark):
    page = "<p>word</p><img src=x.png>" * 100_000
    items = media.parse_html(spark.createDataFrame([(1, page)], "page_id long, html string")).first()["items"]
    assert len(items) == 200_000 and items[-1]["position"] == 199_999


def test_pages_parse(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = media.parse_html(pages).collect()
    assert len(rows) == pages.count() and all([x["position"] for x in r["items"]] == list(range(len(r["items"]))) for r in rows)
    assert all("track(" not in x["text"] for r in rows for x in r["items"])


def expected(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def check_licenses(docs):
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text in docs.select("doc_id", "text").collect():
        r = by_id[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == expected(text or "")
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    return by_id


def test_license_base(spark, sf_dir):
    check_licenses(odd(spark))
    check_licenses(odd(spark).limit(0))
    found = check_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert Counter(r["labels"] for r in found.values())["apache,apache-2.0"] >= 5


def test_license_templates(spark):
    notice = next(t for k, t, _ in licenses.TEMPLATES if k == "mit-text")
    cut = notice.split()
    rows = [(1, "intro words here " + notice + " and more"), (2, " ".join(cut[:9] + ["inserted"] + cut[9:])), (3, " ".join(cut[: len(cut) // 2])), (4, " ".join(sorted(cut))), (5, "nothing of the kind with the permission of any person")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit-text" and got[1]["score"] == 1.0 and got[2]["labels"] == "mit-text"
    assert [got[k]["labels"] for k in (3, 4, 5)] == ["", "", ""] and got[5]["score"] == 0.0


def labels_by_force(text):
    """Every template at every place of a text."""
    words, out = licenses.words_of(text), {}
    for label, template, phrases in licenses.TEMPLATES:
        own, keys = licenses.words_of(template), [licenses.words_of(p) for p in phrases]
        for begin in range(-len(own) - 3, len(words) + 3):
            share = sum(w in words[max(0, begin + i - 3) : max(0, begin + i + 4)] for i, w in enumerate(own)) / len(own)
            part = words[max(0, begin - 3) : max(0, begin + len(own) + 3)]
            if share >= 0.8 and all(any(part[i : i + len(key)] == key for i in range(len(part))) for key in keys):
                out[label] = max(out.get(label, 0.0), share)
    return ",".join(f"{k}={v:.4f}" for k, v in sorted(out.items()))


def test_many_licenses_in_one_file(spark):
    notices = {(label, text) for label, text, _ in licenses.TEMPLATES}
    four = [t for k, t in sorted(notices) if k in ("mit-text", "bsd", "mit-notice", "cc-by-nc-4.0", "cc-by-sa-4.0") or t == "Licensed under the Apache License, Version 2.0."]
    every = [t for _, t in sorted(notices)]
    holes = [" ".join(w for i, w in enumerate(t.split()) if i % 6 != 4) for t in every]
    rows = list(enumerate(["\n".join(four), "\n".join(every), "\n".join(reversed(every)), "\n".join(holes), "a b c " + " x y z ".join(every) + " " + every[0][:40]] + every))
    # files that make the words of the short notices common
    rows += [(100 + k, "released under the mit license version 2 0 cc by nc sa 4") for k in range(200)]
    docs = spark.createDataFrame([(k, t, "x", 0.5) for k, t in rows], "doc_id long, text string, labels string, score double")
    got = {r["doc_id"]: r["found"] for r in licenses.scan(docs).collect()}
    forced = {t: labels_by_force(t) for t in {t for _, t in rows}}
    assert got == {k: forced[t] for k, t in rows}
    assert {x.split("=")[0] for x in got[1].split(",")} == {k for k, _ in notices}


def test_index_against_force_at_any_rarity():
    """Whatever words are rare, the intersected places lose no template; words of the index only are looked up."""
    rng = random.Random(5)
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in licenses.words_of(t)})
    matches = 0
    for _ in range(60):
        rarity = {w: rng.choice([0.0, rng.random()]) for w in vocabulary}
        index = licenses.Index(licenses.TEMPLATES, rarity)
        assert index.rare < index.vocabulary
        parts = []
        for _ in range(rng.randint(0, 3)):
            drop = rng.choice([0, 0.1, 0.2])
            notice = [w for w in rng.choice(licenses.TEMPLATES)[1].split() if rng.random() > drop]
            at = rng.randint(0, len(notice))
            notice[at:at] = [rng.choice(["zz", "the", "license"])] * rng.randint(0, 3)
            parts += notice + [w.decode() for w in rng.choices(vocabulary, k=rng.randint(0, 8))]
        text = " ".join(parts)
        found = index.scan(licenses.words_of(text))
        assert ",".join(f"{k}={v:.4f}" for k, v in sorted(found.items())) == labels_by_force(text)
        matches += len(found)
    assert matches > 30


def test_agreeing_places():
    at = [np.array([0, 2, 40]), np.array([3, 46]), np.array([10])]
    whole = range(-20, 80)
    for needed in (1, 2, 3):
        forced = [b for b in whole if sum(any(abs(x - b) <= licenses.SLIP for x in own) for own in at) >= needed]
        assert licenses._agreeing(at, needed).tolist() == forced
