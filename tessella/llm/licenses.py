"""Operator 9: licence scans by a positional index of rare words.

Licence templates are notices and whole paragraphs with mandatory key phrases.  How rare each
of their words is comes from all files (one counter a word).  The index has, of each template,
the words of highest IDF, two more than may be missing from it: word -> (template, position).
A file's words are looked up there; each posting says where the template would begin, which is
the word's place in the file less its place in the template.  These relative positions are
intersected: a template is a candidate wherever all but the words that may be missing agree
within the slip.  Wherever a template matches, they do, so no match is lost and commoner words
are never looked up.  A candidate counts if all its key phrases stand in that part and enough
of its words stand within a few places of where they should.

Base labels, by contract, are given wherever the words of a fixed phrase stand in a row.

Defined results: words are runs of a-z (A-Z lower-cased), digits and non-ASCII characters; a
null or empty text has no words, no labels and score 0; the score is 1 with a base label, else
the best template's share of words over all places of the file; a null id stays null; very long
texts are read whole, in memory that grows with them; an empty table gives no rows; columns of
the input, of any name, don't clash with those of the result.
"""

from __future__ import annotations

import tomllib
from collections import Counter, defaultdict
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, inputs, map_batches, text_or_empty

#: The contract's phrases and labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

def read_templates(toml: str) -> list[tuple[str, str, list[str]]]:
    """(label, text, phrases that must stand in it) of every template of a TOML text."""
    return [(t["label"], t["text"], t["phrases"]) for t in tomllib.loads(toml)["template"]]


#: Notices and paragraphs of public licences, from the data file of this package.
TEMPLATES = read_templates(files("tessella.llm").joinpath("licenses.toml").read_text("utf-8"))

#: How far a word may stand from its place; share of a template's words that must be there;
#: of the words in the index, how many must be there at least.
SLIP, LEAST_SHARE, LEAST_VOTES = 3, 0.8, 2

_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Index:
    def __init__(self, templates: list[tuple[str, str, list[str]]], rarity: dict[bytes, float] | None = None):
        self.labels = [label for label, _, _ in templates]
        self.texts = [words_of(text) for _, text, _ in templates]
        self.keys = [[words_of(p) for p in phrases] for _, _, phrases in templates]
        self.vocabulary = frozenset(word for words in self.texts for word in words)
        # word -> (template, position), of each template's words of highest IDF only
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for k, words in enumerate(self.texts):
            missing = sum((len(words) - n) / len(words) >= LEAST_SHARE for n in range(1, len(words) + 1))
            order = sorted(range(len(words)), key=lambda i: (-(rarity or {}).get(words[i], 0.0), words[i], i))
            chosen = order[: missing + LEAST_VOTES]
            self.needed.append(len(chosen) - missing)
            for at in chosen:
                self.postings[words[at]].append((k, at))
        self.rare = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> dict[str, float]:
        """label -> best share of words, for the templates that pass."""
        looked_up: dict[int, list[int]] = defaultdict(list)
        for word in self.rare.intersection(words):
            for k, at in self.postings[word]:
                looked_up[k].append(at)
        open_ = sorted(k for k, at in looked_up.items() if len(at) >= self.needed[k])
        if not open_:
            return {}
        wanted = {word for k in open_ for word in self.texts[k]}
        found_at: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if word in wanted:
                found_at[word].append(at)
        stands = {word: np.array(at, np.int64) for word, at in found_at.items()}
        found: dict[str, float] = {}
        for k in open_:
            begins = _agreeing([stands[self.texts[k][at]] - at for at in looked_up[k]], self.needed[k])
            for key in self.keys[k]:
                begins = self._with_phrase(k, key, words, begins)
            if len(begins):
                share = float(self._hits(k, stands, begins).max()) / len(self.texts[k])
                if share >= LEAST_SHARE:
                    found[self.labels[k]] = max(found.get(self.labels[k], 0.0), share)
        return found

    def _with_phrase(self, k: int, key: list[bytes], words: list[bytes], begins: np.ndarray) -> np.ndarray:
        """The begins in whose part of the file the key phrase stands."""
        at = np.array(places(words, key) if len(begins) else [], np.int64)
        if not len(at):
            return begins[:0]
        first = np.searchsorted(at, begins - SLIP)
        inside = at[np.minimum(first, len(at) - 1)] + len(key) <= begins + len(self.texts[k]) + SLIP
        return begins[(first < len(at)) & inside]

    def _hits(self, k: int, stands: dict[bytes, np.ndarray], begins: np.ndarray) -> np.ndarray:
        """For every begin, how many words of the template stand near their places."""
        hits = np.zeros(len(begins), np.int64)
        for place, word in enumerate(self.texts[k]):
            at = stands.get(word)
            if at is not None:
                first = np.searchsorted(at, begins + place - SLIP)
                hits += (first < len(at)) & (at[np.minimum(first, len(at) - 1)] <= begins + place + SLIP)
        return hits


def _agreeing(relative: list[np.ndarray], needed: int) -> np.ndarray:
    """The begins that lie within SLIP of a relative position of ``needed`` postings or more;
    each of the sorted arrays has one posting's."""
    starts, ends = [], []
    for at in relative:
        apart = np.diff(at) > 2 * SLIP  # a posting counts once where its own reaches overlap
        starts.append(at[np.r_[True, apart]] - SLIP)
        ends.append(at[np.r_[apart, True]] + SLIP + 1)
    edges = np.concatenate(starts + ends)
    steps = np.repeat([1, -1], [sum(map(len, starts)), sum(map(len, ends))])
    order = np.argsort(edges, kind="stable")
    edges, agree = edges[order], np.cumsum(steps[order])
    if not (agree >= needed).any():
        return edges[:0]
    lengths = np.diff(edges, append=edges[-1]) * (agree >= needed)
    return np.repeat(edges - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand in a row."""
    out, at, first, n = [], -1, phrase[0], len(phrase)
    try:
        while True:
            at = words.index(first, at + 1)
            if words[at : at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return inputs(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text"))


def rarity(texts: DataFrame, templates: list = TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency of every licence word over all files."""
    vocabulary = Index(templates).vocabulary

    def run(batches):
        counts, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
                n += 1
        rows = [(w.decode(), c) for w, c in counts.items()] + [("", n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    sums = dict(texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n")).collect())  # one row a licence word
    n = sums.pop("", 0)
    return {w: float(np.log((1 + n) / (1 + sums.get(w.decode(), 0)))) for w in vocabulary}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found; the
    last has the method's labels with their shares."""
    texts = _texts(docs, id_col, text_col)
    rare = rarity(texts, templates)
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def start():
        index = Index(templates, rare)
        phrases = [(words_of(p), label) for p, label in BASE_PHRASES.items()]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                at = [(x, label) for phrase, label in phrases for x in places(words, phrase)]
                base = {label for _, label in at}
                found = index.scan(words)
                score = 1.0 if base else max(found.values(), default=0.0)
                rows.append((len(words), len(at), min((x for x, _ in at), default=None), max((x for x, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score, ",".join(f"{k}={v:.4f}" for k, v in sorted(found.items()))))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

        return step

    return map_batches(texts, start, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found string")
