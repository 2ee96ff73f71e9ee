"""Operator 5: token counts of a unigram vocabulary, without the tokens.

Count-only Viterbi: an Aho-Corasick automaton over the vocabulary's pieces enumerates all
matches that end at each character; dynamic programming carries, for each place, the best sum
of scores and the number of pieces on the way there.  Tie rules are those of the unigram
tokenizer: a path is replaced by a strictly better one only, and paths are offered by start,
so of equal ones the longest last piece wins; a character without a piece of its own also gets
an unknown node of the worst score less ``UNKNOWN_PENALTY``, which counts its UTF-8 bytes
(byte fallback; otherwise neighbouring unknowns are one piece).

No piece spans a word border (a space mark behind another character), so words are counted
apart and each distinct word once by a worker.

Defined results: a null or empty text has 0 tokens; ids repeat and are null as in the table; an
empty table gives no rows.  A text without spaces is one word, whose matches are all held.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.chunks import ChunkCache
from tessella.llm.common import bounded_batches, inputs, kept, map_batches, text_or_empty

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass
class Unigram:
    """Pieces with their scores; with ``bytes_`` unknown characters count their bytes."""

    pieces: list[tuple[str, float]]
    bytes_: bool = True

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(self.pieces).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.unknown = min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY
        if self.pieces:
            self.automaton.make_automaton()
        self.borders = all(SPACE not in p.lstrip(SPACE) for p, _ in self.pieces)

    def count(self, text: str) -> int:
        """The number of pieces of the best path through ``text`` (spaces already marked)."""
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text) if self.pieces else ():
            ending[end].append(match)
        best, pieces, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)  # open_: an unknown ends here
        for end in range(1, n + 1):
            top, start, unknown = None, 0, True
            for size, score in sorted(ending[end - 1], reverse=True):  # by start
                if size == 1:
                    unknown = False
                total = best[end - size] + score
                if top is None or total > top:
                    top, start = total, end - size
            lone = False
            if unknown and (top is None or best[end - 1] + self.unknown > top):
                top, start, lone = best[end - 1] + self.unknown, end - 1, True
            best[end], open_[end] = top, lone
            if not lone:
                pieces[end] = pieces[start] + 1
            elif self.bytes_:
                pieces[end] = pieces[start] + len(text[start].encode("utf-8", "surrogatepass"))
            else:
                pieces[end] = pieces[start] + (not open_[start])
        return pieces[n]


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model file and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]


def counter(path: str) -> ChunkCache:
    counters: dict[str, ChunkCache] = kept(__name__)
    if path not in counters:
        model = Unigram(read_vocabulary(path))
        if not model.borders:
            raise ValueError("a piece of this vocabulary spans a word border")
        counters[path] = ChunkCache(lambda words: [model.count(SPACE + w) for w in words])
    return counters[path]


def words_of(text: str) -> list[str]:
    """The words of a text, each to be read with one space mark before it; what stands for
    further spaces leads its word."""
    if "  " not in text and SPACE not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    marked = SPACE + text.replace(" ", SPACE)
    return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", marked)]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_chars of every text."""
    bounded_batches(docs.sparkSession)
    slim = inputs(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text"))

    def start():
        cache = counter(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            counts = [sum(v) if t else 0 for t, v in zip(texts, cache.values([words_of(t) for t in texts]), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

        return step

    return map_batches(slim, start, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_chars long")
