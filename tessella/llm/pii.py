"""Operator 4: personal data, found by form and by what the corpus says of the words beside it.

Built from DataFrame functions alone.  E-mail addresses, IP addresses, payment cards and phone
numbers are found by pattern and validated; they are the protected entities.  The method is
information-theoretic sanitisation: around each occurrence of an entity c stand words t within
``WINDOW`` characters of its line.  Over the whole corpus, P(c|t) is the share of t's
occurrences that stand beside c, and

    disclosure(c, t) = PMI(c; t) / IC(c) = 1 + log P(c|t) / -log P(c)

is the part of c's information that t gives away.  A word whose disclosure of any entity
reaches ``GENERALISE`` in at least ``LEAST_CONTEXTS`` different contexts, or one less (but two)
where P(c|t) is 1, is a span of kind ``term`` wherever it stands, in every text;
from ``REMOVE`` on it is removed, else generalised.

Matching is linear in the text: patterns carry no nested repetition.  Where one is asked for
(labels of a domain, groups of digits), single separators are first replaced by a mark of the
same length, so that a plain run of characters says the same.  Places are running sums over
the lengths of gaps and hits, and surroundings are cut from pieces of the text of a fixed
length, so that a text of very many matches takes no longer a match than one of few.

Defined results: a null text is empty; no match gives counts of 0 and empty strings; rows that
repeat an id are judged by their own texts; spans of different kinds may overlap, of one kind
never; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrays import bound, running
from tessella.llm.common import inputs, materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Characters on either side in which a word stands beside an entity.
WINDOW = 80
#: Parts of an entity's information from which a word is generalised and removed.
GENERALISE, REMOVE = 0.9, 0.995
#: Different surroundings that a word and an entity must share, one less where P(c|t) is 1;
#: copies of one don't count.
LEAST_CONTEXTS = 3

#: Code points of a piece of a text.
PIECE = 256

_MARK, _NOT_MARK = "\x01", "\x02"
_DOT_IN_DOMAIN = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
_SEPARATOR_IN_DIGITS = r"(?<=[0-9])[ -](?=[0-9])"
_LOCAL = rf"A-Za-z0-9._%+{_MARK}-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9{_MARK}]{{2,}}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_NO_WORD = r"[^\p{L}\p{N}_]+"


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches, leftmost first, not overlapping: array of (start, end, hit) in code
    points, from the gaps that a split leaves between them."""
    pattern_ = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern_, F.lit(0))
    pairs = F.zip_with(F.split(text, pattern_, F.lit(-1)), hits, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")))
    found = F.filter(pairs, lambda p: p["hit"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: p["gap"] + F.char_length(p["hit"])), F.lit(0), lambda a, n: a + n)
        starts = F.zip_with(pairs, ends, lambda p, before: F.struct((before + p["gap"]).alias("start"), p["hit"].alias("hit")))
        return F.transform(starts, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.char_length(s["hit"])).alias("end"), s["hit"].alias("hit")))

    return bound(found, placed)


def pieces(text: Column) -> Column:
    """A text cut every ``PIECE`` code points: ``between`` finds its parts without walking
    through all that stands before them."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    around = F.array_join(F.slice(cut, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
    return F.substring(around, start - first * PIECE + 1, end - start)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


_VALID = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: F.forall(F.split(hit, r"\."), lambda part: part.cast("double") <= 255),
    "card": lambda hit: F.when(F.length(_digits(hit)).between(13, 19), _luhn(_digits(hit))).otherwise(False),
    "phone": lambda hit: F.length(_digits(hit)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Validated spans by kind and start: array of (kind, start, end)."""
    plain = F.replace(text, F.lit(_MARK), F.lit(_NOT_MARK))
    marked = {"email": F.regexp_replace(plain, _DOT_IN_DOMAIN, _MARK), "card": F.regexp_replace(plain, _SEPARATOR_IN_DIGITS, _MARK)}
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    parts = []
    for kind in KINDS:
        needed = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_NEEDED[kind])
        parts.append(F.when(needed, _valid_spans(kind, marked.get(kind, plain))).otherwise(none))
    return F.concat(*parts)


def _valid_spans(kind: str, text: Column) -> Column:
    found = F.filter(matches(text, _PATTERNS[kind]), lambda m: _VALID[kind](m["hit"]))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _beside(cut: Column, span: Column) -> Column:
    """The occurrence of an entity with the words beside it in its line: (kind, entity,
    context, words).  ``cut``: the text in pieces."""

    def around(sides: Column) -> Column:
        words = F.concat(F.split(sides["left"], _NO_WORD), F.split(sides["right"], _NO_WORD))
        words = F.filter(F.transform(words, F.lower), lambda w: (F.char_length(w) >= 3) & ~w.rlike("^[0-9]+$"))
        return F.struct(span["kind"].alias("kind"), sides["entity"].alias("entity"), F.xxhash64(sides["left"], sides["right"]).alias("context"), F.array_distinct(words).alias("words"))

    value = between(cut, span["start"], span["end"])
    entity = F.when(span["kind"].isin("card", "phone"), _digits(value)).otherwise(F.lower(value))
    left = F.substring_index(between(cut, F.greatest(F.lit(0), span["start"] - WINDOW), span["start"]), "\n", -1)
    right = F.substring_index(between(cut, span["end"], span["end"] + WINDOW), "\n", 1)
    # a word that the window's edge cuts is not one: leave it out where the window is full
    left = bound(left, lambda x: F.when(F.char_length(x) >= WINDOW, F.regexp_replace(x, r"^[\p{L}\p{N}_]+", "")).otherwise(x))
    right = bound(right, lambda x: F.when(F.char_length(x) >= WINDOW, F.regexp_replace(x, r"[\p{L}\p{N}_]++$", "")).otherwise(x))
    return bound(F.struct(entity.alias("entity"), left.alias("left"), right.alias("right")), around)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base spans and the surroundings of each, for every row."""
    slim = inputs(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text"))

    def told(base: Column) -> Column:
        beside = bound(pieces(F.col("text")), lambda cut: F.transform(base, lambda s: _beside(cut, s)))
        none = F.expr("cast(array() as array<struct<kind:string,entity:string,context:bigint,words:array<string>>>)")
        return F.struct(base.alias("base"), F.when(F.size(base) > 0, beside).otherwise(none).alias("beside"))

    found = slim.select("doc_id", F.xxhash64("text").alias("text_key"), bound(base_spans(F.col("text")), told).alias("found"))
    return found.select("doc_id", "text_key", "found.base", "found.beside")


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: occurrences of every word in the whole corpus, summed up before the shuffle."""
    text = F.lower(text_or_empty(docs[text_col]))
    return docs.select(F.explode(F.split(text, _NO_WORD)).alias("term")).where(F.char_length("term") >= 3).groupBy("term").agg(F.count("*").alias("n"))


def disclosures(scanned: DataFrame, counts: DataFrame, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """kind, entity, term, disclosure of the word-entity pairs in enough contexts."""
    seen = scanned.select(F.explode("beside").alias("b")).select("b.kind", "b.entity", "b.context", F.explode("b.words").alias("term"))
    alike = seen.groupBy("kind", "entity", "term", "context").agg(F.count("*").alias("n"))  # copies collapse
    joint = alike.groupBy("kind", "entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts")).where(F.col("contexts") >= least_contexts - 1)
    own = scanned.select(F.explode("beside").alias("b")).groupBy("b.kind", "b.entity").agg(F.count("*").alias("occurrences"))
    # a word's occurrences inside entities say nothing of those outside
    inner = scanned.select(F.explode("beside").alias("b")).select(F.explode(F.split("b.entity", _NO_WORD)).alias("term")).groupBy("term").agg(F.count("*").alias("inner"))
    known = joint.join(own, ["kind", "entity"]).join(counts, "term").join(inner, "term", "left")
    words = counts.agg(F.sum("n")).first()[0] or 1  # one number
    given = F.log(F.least(F.lit(1.0), F.col("together") / F.greatest(F.lit(1), F.col("n") - F.coalesce("inner", F.lit(0)))))
    information = -F.log(F.least(F.col("occurrences") / F.lit(words), F.lit(0.5)))
    enough = (F.col("contexts") >= least_contexts) | ((F.col("contexts") > 1) & (given == 0))
    return known.where(enough).select("kind", "entity", "term", (1 + given / information).alias("disclosure"))


def _everywhere(docs: DataFrame, strong: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, start, end, disclosure: all occurrences of the strong terms in all
    texts.  Texts and terms meet as words without their places; only in the texts that hold a
    strong term its places are looked for."""
    slim = inputs(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    word = F.explode(F.array_distinct(F.split("text", _NO_WORD))).alias("word")
    words = slim.select("doc_id", "text_key", word).where(F.char_length("word") >= 2)  # lower case may be longer
    held = words.withColumn("term", F.lower("word")).join(strong, "term").groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_set(F.struct("word", "disclosure"))).alias("held"))
    held = held.select(F.col("doc_id").alias("held_id"), F.col("text_key").alias("held_key"), "held")
    texts = slim.join(held, (F.col("text_key") == F.col("held_key")) & F.col("doc_id").eqNullSafe(F.col("held_id")))
    # words are letters, digits and _ alone, so they stand for themselves in a pattern
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(F.map_keys("held"), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    found = texts.select("doc_id", "text_key", "held", F.explode(matches(F.col("text"), pattern)).alias("m"))
    return found.select("doc_id", "text_key", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.try_element_at("held", F.col("m.hit")).alias("disclosure"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """doc_id, text_key, base and terms of every row; terms: array of (start, end, disclosure)."""
    scanned = materialise(scan(docs, id_col, text_col), "pii")
    counts = materialise(term_counts(docs, text_col), "terms")
    strong = disclosures(scanned, counts, least_contexts).where(F.col("disclosure") >= generalise)
    strong = materialise(strong.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "strong")
    told = _everywhere(docs, strong, id_col, text_col)
    terms = told.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "disclosure"))).alias("terms"))
    terms = terms.select(F.col("doc_id").alias("told_id"), F.col("text_key").alias("told_key"), "terms")
    joined = scanned.select("doc_id", "text_key", "base").join(terms, (F.col("text_key") == F.col("told_key")) & F.col("doc_id").eqNullSafe(F.col("told_id")), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int,disclosure:double>>)")
    free = F.when(F.size("base") == 0, F.col("terms")).otherwise(_outside(F.col("terms"), F.col("base")))
    return joined.select("doc_id", "text_key", "base", F.coalesce(free, none).alias("terms"))


def _outside(terms: Column, base: Column) -> Column:
    """The terms that overlap no base span: a word inside a base span is no span of its own.

    Over both kinds in the order of their places, the furthest end of a base span before a
    term and the nearest start of one behind it decide."""

    def judged(both: Column) -> Column:
        ends = running(F.transform(both, lambda s: F.when(s["disclosure"].isNull(), s["end"]).otherwise(-1)), F.lit(-1), lambda a, n: F.greatest(a, n))
        far = 2**31 - 1
        starts = F.reverse(running(F.reverse(F.transform(both, lambda s: F.when(s["disclosure"].isNull(), s["start"]).otherwise(far))), F.lit(far), lambda a, n: F.least(a, n)))
        after = F.zip_with(both, ends, lambda s, e: F.when(s["disclosure"].isNotNull() & (e <= s["start"]), s))
        free = F.zip_with(after, starts, lambda s, n: F.when(n >= s["end"], s))
        return F.filter(free, lambda s: s.isNotNull())

    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("double").alias("disclosure")))
    return bound(F.array_sort(F.concat(plain, terms)), judged)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The digest of all spans: doc_id, counts by kind, base_sha256, spans, n_term."""
    found = spans(docs, id_col, text_col, **options)
    counts = [_count(kind) for kind in KINDS]
    terms = F.transform("terms", lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", terms)).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """``docs`` with every span of its text replaced: base spans by their kind, as [EMAIL],
    terms by [TERM] or, from ``remove`` on, by nothing.  Texts without spans stay as they are."""
    own, key = "__tessella_id", "__tessella_key"
    found = spans(docs, id_col, text_col, **options)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("as")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosure"] >= remove, "").otherwise("[TERM]").alias("as")))
    merged = bound(F.array_sort(F.concat(base, terms)), _merged)
    cut = found.where((F.size("base") > 0) | (F.size("terms") > 0)).select(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), merged.alias("__tessella_cut"))
    cut = cut.dropDuplicates(["cut_id", "cut_key"])
    rows = docs.withColumns({own: docs[id_col], key: F.xxhash64(text_or_empty(docs[text_col]))})
    joined = rows.join(cut, (F.col(key) == F.col("cut_key")) & F.col(own).eqNullSafe(F.col("cut_id")), "left")
    text = F.col(f"`{text_col}`").cast("string")
    return joined.select(*(F.when(F.col("__tessella_cut").isNull(), text).otherwise(_replaced(text, F.col("__tessella_cut"))).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def _merged(spans: Column) -> Column:
    """Sorted spans (start, end, as) where those that overlap are one, under the name of the
    first: a span opens one unless an earlier one ends behind its start."""

    def opened(before: Column) -> Column:
        heads = F.filter(F.zip_with(spans, before, lambda s, e: F.when(e <= s["start"], F.struct(s["start"].alias("start"), s["as"].alias("as"), e.alias("before")))), lambda h: h.isNotNull())
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        # what a span opens ends where all before the next one had ended
        ends = bound(heads, lambda own: F.concat(F.transform(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda h: h["before"]), F.array(last)))
        return F.zip_with(heads, ends, lambda h, e: F.struct(h["start"].alias("start"), e.alias("end"), h["as"].alias("as")))

    return F.when(F.size(spans) == 0, spans).otherwise(bound(running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, n: F.greatest(a, n)), opened))


def _replaced(text: Column, spans: Column) -> Column:
    """A text with its spans (sorted, apart) replaced."""

    def written(cut: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        parts = F.zip_with(before, spans, lambda b, s: F.when(s.isNull(), between(cut, b, F.char_length(text))).otherwise(F.concat(between(cut, b, s["start"]), s["as"])))
        return F.array_join(parts, "")

    return bound(pieces(text), written)
