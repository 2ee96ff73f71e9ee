"""Operator 3: media columns in interleaved documents.

HTML is parsed into an ordered sequence of structs: texts, and references to media by the
digest in their address, with their captions.  References are joined to a media table by that
digest (digests that very many references name apart from the others), and what is found comes
back at the reference's own position, so that positions and captions stay aligned.  Payloads are stored losslessly as 8-bit mono WAV; features are computed
from the stored bytes as they are read back.

Defined results: a null text is stored as 64 bytes of 0, as an empty one; equal texts have one
digest and so equal values; references without a digest, or whose digest the media table
lacks, stay in the sequence unresolved (null payload columns); media that repeat a digest count
once; null HTML is an empty sequence; a null id stays null; very long texts and pages are read
whole; an empty table gives no rows; columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
import re
import wave
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, inputs, join_hot, map_batches, materialise, text_or_empty

#: Payloads are padded with bytes of 0 to a positive multiple of this.
BLOCK = 64
SAMPLE_RATE = 8_000
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
#: An address that carries a SHA-256 digest.
_digest_in = re.compile(r"(?:^|[^0-9a-f])([0-9a-f]{64})(?:$|[^0-9a-f])").search

#: Elements of HTML.
_MEDIA = {"img", "audio", "video", "source", "embed"}
_SILENT = {"script", "style", "template", "noscript", "title"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "var", "wbr"}


class Sequence(HTMLParser):
    """Texts between block elements, and media references, in the order of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None  # references that wait for their caption
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag not in _INLINE:
            self.flush()
        if tag in _MEDIA:
            found = dict(attrs)
            if src := found.get("src"):
                digest = _digest_in(src.lower())
                caption = " ".join((found.get("alt") or found.get("title") or "").split()) or None
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"position": len(self.items), "kind": "media", "text": src, "digest": digest and digest[1], "caption": caption})
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []

    def handle_endtag(self, tag):
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for k in self.figure or ():
                self.items[k]["caption"] = text or self.items[k]["caption"]
            self.caption = None
        elif tag == "figure":
            self.figure = None
        if tag not in _INLINE:
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.words.append(data)


def parse_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", id_name: str = "doc_id") -> DataFrame:
    """One row a page: its id and the ordered items of its sequence."""
    bounded_batches(pages.sparkSession)
    slim = inputs(pages, **{id_name: id_col}, html=html_col).select(id_name, text_or_empty(F.col("html")).alias("html"))
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for html in batch.column(1).to_pylist():
            parser = Sequence()
            parser.feed(html)
            parser.close()
            parser.flush()
            out.append(parser.items)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], [id_name, "items"])

    return map_batches(slim, lambda: step, f"{id_name} {slim.schema[id_name].dataType.simpleString()}, items array<{ITEM}>")


def payload_of(text: Column) -> Column:
    """A text's UTF-8 bytes with zeros up to a positive multiple of BLOCK."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(raw)
    lack = F.when(size == 0, BLOCK).otherwise(F.pmod(-size, F.lit(BLOCK)))
    return F.concat(raw, F.encode(F.repeat(F.lit("\0"), lack), "UTF-8"))


def _little_endian(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))


def wav_of(payload: Column) -> Column:
    """The payload as the samples of an 8-bit mono WAV file (the header is 44 bytes)."""
    size = F.octet_length(payload).cast("long")
    rate = _little_endian(F.lit(SAMPLE_RATE).cast("long"))
    form = F.concat(F.unhex(F.lit("1000000001000100")), rate, rate, F.unhex(F.lit("01000800")))
    ascii_ = lambda s: F.encode(F.lit(s), "UTF-8")
    return F.concat(ascii_("RIFF"), _little_endian(size + 36), ascii_("WAVEfmt "), form, ascii_("data"), _little_endian(size), payload)


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The media table of a column of texts, written to the shared folder: digest, stored.

    A task writes a payload once, however many of its rows hold it; so one that any number of
    documents share is stored, read back and hashed at most once a task, and no payload is
    shuffled for it."""
    bounded_batches(docs.sparkSession)
    payload = payload_of(text_or_empty(docs[text_col]))
    media = docs.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("digest"), wav_of(F.col("payload")).alias("stored"))

    def start():
        written: set[str] = set()  # at most a digest a row of the task

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = []
            for digest in batch.column(0).to_pylist():
                new.append(digest not in written)
                written.add(digest)
            return batch.filter(pa.array(new, pa.bool_()))

        return step

    return materialise(map_batches(media, start, "digest string, stored binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes of each digest hold, read back as samples; one row a digest."""
    bounded_batches(media.sparkSession)
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with wave.open(io.BytesIO(stored)) as sound:
                payload = sound.readframes(sound.getnframes())
            samples = np.frombuffer(payload, np.uint8)
            bands = np.bincount(samples >> 4, minlength=16)
            centred = samples.astype(np.int16) - 128
            crossings = int(np.count_nonzero(np.diff(np.signbit(centred))))
            rms = float(np.sqrt(np.einsum("i,i->", centred.astype(np.float64), centred) / len(samples)))
            feature = f"rms={rms:.6f};crossings={crossings};bands=" + ".".join(map(str, bands))
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = map_batches(media.select("digest", "stored"), lambda: step, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.groupBy("digest").agg(F.min(F.struct(*names[1:])).alias("media")).select("digest", "media.*")


def resolve(sequences: DataFrame, media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row an item of a sequence, media references with the columns of ``media`` (one row
    a digest)."""
    rows = sequences.select(id_col, F.explode("items").alias("item")).select(id_col, "item.*")
    asks = materialise(rows.where("digest is not null"), "references")
    names = [id_col, "position", "kind", "text", "caption", *media.columns]
    found = join_hot(asks, media, ["digest"]).select(*names)
    return found.unionByName(rows.where("digest is null").select(*names[:5], "digest"), allowMissingColumns=True)


def references(sequences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a sequence and digest that it refers to, with the positions and captions of
    these references in the order of the page and the number of texts around them."""
    refs = F.filter("items", lambda x: x["digest"].isNotNull())
    rows = sequences.select(id_col, F.size(F.filter("items", lambda x: x["kind"] == "text")).alias("n_texts"), refs.alias("refs"))
    rows = rows.select(id_col, "n_texts", "refs", F.explode(F.array_distinct(F.transform("refs", lambda x: x["digest"]))).alias("digest"))
    own = F.filter("refs", lambda x: x["digest"] == F.col("digest"))
    return rows.select(id_col, "digest", "n_texts", F.transform(own, lambda x: x["position"]).alias("positions"), F.transform(own, lambda x: x["caption"]).alias("captions"))


def interleave(resolved: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("digest", "payload_bytes", "feature")) -> DataFrame:
    """Resolved items as one ordered sequence a document again."""
    item = F.struct("position", "kind", "text", "caption", *columns)
    return resolved.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("items"))


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """A page of a text's own paragraphs between two references to its payload: a figure with
    a caption, and at the end a plain element with a title."""
    plain = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        plain = F.replace(plain, F.lit(sign), F.lit(entity))
    address = F.concat(F.lit('<audio src="sha256:'), digest, F.lit('"'))
    figure = F.concat(F.lit("<article><figure>"), address, F.lit("></audio><figcaption>"), caption, F.lit("</figcaption></figure><p>"))
    return F.concat(figure, F.regexp_replace(plain, "\n+", "</p><p>"), F.lit("</p>"), address, F.lit(' title="whole text"></audio></article>'))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a stored payload that its own page refers to, read back through these
    references: doc_id, n_bytes, the payload's features, positions, captions, n_texts."""
    media = store(docs, text_col)
    slim = inputs(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text"))
    size = F.octet_length(F.encode("text", "UTF-8")).cast("string")
    digest = F.sha2(payload_of(F.col("text")), 256)
    pages = slim.select("doc_id", page_of(F.col("text"), digest, size).alias("html"))
    refs = materialise(references(parse_html(pages, "doc_id", "html")), "references")
    found = join_hot(refs, features(media), ["digest"])
    n_bytes = F.get("captions", F.lit(0)).cast("long").alias("n_bytes")  # the figure's
    return found.select("doc_id", n_bytes, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "positions", "captions", "n_texts")
