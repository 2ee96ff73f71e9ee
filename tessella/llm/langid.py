"""Operator 6: language identification by a sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams of the lower-cased text, whose
non-letters count as one kind of gap.  Document frequencies come from every training text.
The regression is trained with follow-the-regularised-leader (proximal) and elastic-net
penalties, one example at a time, on every training text.  Hashes of id and text deal the rows
to shards of about ``SHARD_ROWS``; each is learned from in its task, and a weight of the model
is the mean of the shards' own, each by its squared gradients there (FTRL's ``n``), so that a
shard counts by what it saw of that feature and language.  Every fifth row, by its hash, lies in
shards of its own: a model of the other shards predicts these rows, which fits one temperature, by
which scores are divided before the softmax, so that the score is a calibrated probability.
The final weights are those of all shards.  Sums are of whole numbers, and a shard's rows come
in the order of their hashes, so that results don't depend on how the table is stored.

A softmax over the learned languages finds one for any text, also for code, noise or another
script.  So the model also knows how surprising a text's 3-grams are (their mean inverse
document frequency), and the most that any training text had, but for the most surprising one in
``OUTLIERS``, which may be in no language either; ``keep_identified`` rejects texts that exceed
this by ``MARGIN``: they are in no learned language.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text when nothing can be learned from (no labelled row with a letter).  Rows without a
language are predicted but not learned from.  Equal texts get equal results; of equally likely
languages the first by name is predicted.  Ids may be null or repeat; rows that repeat are
learned from once.  Fewer than 20 training texts fit no temperature, which then is 1.  A shard
of long texts is learned from in blocks of at most ``BLOCK_FEATURES``.  A very long text is read
whole, in memory that grows with it; an empty table gives no rows; columns may have any name.
Only a caller who gives ``sample_rows`` has the regression, the temperature and the surprise
from a sample of that many rows, dealt evenly to the languages.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, inputs, kept, map_batches, map_task, materialise

UNDETERMINED = "und"
#: Hashed features for each length of n-gram.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Rows that a shard holds on average, and features of its rows (repeats of a row's not counted)
#: that are held at a time.
SHARD_ROWS, BLOCK_FEATURES = 4_096, 4_000_000
#: A text shorter than this many letters is still predicted, from what it has.
EPOCHS = 3
#: FTRL-proximal: learning rate, its offset, and the weights of both penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Every so manieth row fits the temperature.
CALIBRATION_EVERY = 5
TEMPERATURES = np.geomspace(0.2, 20, 241)
#: How many times the training texts' greatest surprise a text's may be, and of how many of
#: them one is left out of account.
MARGIN, OUTLIERS = 1.2, 1_000
#: Gradients, weights and losses are added as multiples of this, exactly.
UNIT = 2.0**-28


def letter_codes() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    own = kept(__name__)
    if "letters" not in own:
        own["letters"] = np.array([i if unicodedata.category(chr(i))[0] == "L" else 0 for i in range(0x110000)], np.uint32)
    return own["letters"]


def grams(text: str) -> list[np.ndarray] | None:
    """The feature numbers of all n-grams of a text, by length; None without a letter."""
    codes = letter_codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return None
    codes = np.concatenate((np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)))
    out = []
    h = codes
    for n in ORDERS:
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        mixed = h * np.uint32(0x9E3779B1)
        out.append((mixed >> np.uint32(32 - 15)).astype(np.int32) + (n - 1) * BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, times the inverse document frequency
    bias: np.ndarray
    temperature: float
    rarity: np.ndarray | None = None  # inverse document frequencies
    most_surprise: float = float("inf")

    def surprise(self, features: list[np.ndarray]) -> float:
        """The mean inverse document frequency of the longest n-grams."""
        return 0.0 if self.rarity is None else float(self.rarity[features[-1]].mean())

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        total = self.bias.copy()
        for own in features:
            total += self.weights[own].mean(axis=0, dtype=np.float64)
        return total

    def probabilities(self, features: list[np.ndarray]) -> np.ndarray:
        total = self.scores(features) / self.temperature
        e = np.exp(total - total.max())
        return e / e.sum()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return inputs(docs, doc_id=id_col, text=text_col, lang=lang_col)


def statistics(training: DataFrame) -> tuple[np.ndarray, int, list[str]]:
    """Over a table of text and lang: documents with each feature, documents with a letter, the
    languages of these.

    Each task adds up its own; the table of sums has one row a feature and language."""
    size = BUCKETS * len(ORDERS)

    def run(batches):
        counts, languages = np.zeros(size, np.int64), Counter()
        seen = np.zeros(size, bool)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (own := grams(text)) is not None:
                    seen[:] = False
                    for x in own:
                        seen[x] = True
                    counts += seen
                    languages[lang] += 1
        used = np.flatnonzero(counts)
        features = [*used.tolist(), *[-1] * len(languages)]
        names = [*[None] * len(used), *languages]
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.int64()), pa.array(names, pa.string()), pa.array([*counts[used].tolist(), *languages.values()], pa.int64())], ["feature", "lang", "n"])

    sums = map_task(training.select("text", "lang"), run, "feature long, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n"))
    counts, n, languages = np.zeros(size, np.int64), 0, []
    for feature, lang, value in sums.collect():  # at most one row a feature and language
        if feature < 0:
            n += value
            languages.append(lang)
        else:
            counts[feature] = value
    return counts, n, sorted(x for x in languages if x is not None)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over a one-column table of texts: documents with each feature, documents with a letter."""
    return statistics(texts.select(F.col(texts.columns[0]).alias("text"), F.lit(None).cast("string").alias("lang")))[:2]


def term_frequencies(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and the frequency of each among those of its length."""
    features, counts = np.unique(np.concatenate(own), return_counts=True)
    lengths = np.array([len(x) for x in own])
    return features, (counts / lengths[features // BUCKETS]).astype(np.float32)


def sample(training: DataFrame, rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, their frequencies) of at most ``rows`` rows (one a language at
    least): of each language the distinct rows with the smallest hashes of id and text.

    A first bound on the hash, from an estimate of the distinct rows, leaves about twice as many
    as are wanted; rows that repeat, with whatever ids, are collapsed before the exact cut."""
    keyed = training.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    sizes = {lang: n for lang, n in keyed.groupBy("lang").agg(F.approx_count_distinct("key", 0.02)).collect()}
    if not sizes:
        return []
    each = max(1, rows // len(sizes))
    near = F.lit(False)
    for lang, n in sizes.items():
        share = (1.5 * each + 30) / n
        near = near | ((F.col("lang") == lang) & (F.lit(True) if share > 0.99 else F.col("key") < int(share * 2**64) - 2**63))
    once = keyed.where(near).groupBy("lang", "key").agg(F.first("text").alias("text"))
    kept = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("place") <= each)  # about twice ``each`` rows

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], []]
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (own := grams(text)) is not None:
                for column, value in zip(out, (lang, *term_frequencies(own)), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.float32()))], ["lang", "features", "tf"])

    picked = map_batches(kept.select("lang", "text"), lambda: step, "lang string, features array<int>, tf array<float>")
    # one job on all tasks; what comes to the driver is the bounded sample
    picked = materialise(picked, "sample")
    out = [(r[0], np.array(r[1], np.int32), np.array(r[2], np.float32)) for r in picked.toLocalIterator()]
    return sorted(out, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))


def ftrl(taught: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the rows as they come: weights and sums of squared gradients, of the
    features and (last) the bias by language, and the scale that features were divided by."""
    # one common scale, so that step sizes don't depend on the table; folded into the weights
    scale = float(np.mean([np.sqrt(((tf * idf[f]) ** 2).sum()) for _, f, tf in taught])) or 1.0
    size, k = len(idf) + 1, len(languages)
    place = {lang: i for i, lang in enumerate(languages)}
    state = np.zeros((size, 2 * k))  # z and the square root of n; worked on by language, as rows are long
    bias = np.int64(size - 1)
    examples = [(place[lang], np.append(f, bias), np.append(tf * idf[f] / scale, 1.0)) for lang, f, tf in taught]

    def weights(z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (np.clip(z, -L1, L1) - z) / (root / ALPHA + (BETA / ALPHA + L2))

    for _ in range(epochs):
        for gold, at, x in examples:
            own = np.ascontiguousarray(state.take(at, axis=0).T)
            z, root = own[:k], own[k:]
            w = weights(z, root)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[gold] -= 1.0
            g = p[:, None] * x
            grown = np.sqrt(root * root + g * g)
            z += g
            w *= (grown - root) / ALPHA
            z -= w
            root[:] = grown
            state[at] = own.T
    return weights(state[:, :k], state[:, k:]), state[:, k:] ** 2, scale


def surprises(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> list[float]:
    longest = (len(ORDERS) - 1) * BUCKETS  # where the features of the longest n-grams begin
    return [float((tf * idf[f])[f >= longest].sum()) for _, f, tf in rows]


def losses(raw: np.ndarray, gold: np.ndarray, t: float) -> np.ndarray:
    """What each row costs if its scores are divided by ``t`` before the softmax."""
    s = raw / t
    s = s - s.max(axis=1, keepdims=True)
    return np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), gold]


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = EPOCHS) -> Model | None:
    """FTRL-proximal over the rows in a fixed shuffled order, then the temperature."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    order = np.random.default_rng(7).permutation(len(rows))
    apart = [rows[i] for k, i in enumerate(order) if k % CALIBRATION_EVERY == 0 and len(rows) >= 20]
    taught = [rows[i] for k, i in enumerate(order) if not (k % CALIBRATION_EVERY == 0 and len(rows) >= 20)]
    w, _, scale = ftrl(taught, languages, idf, epochs)
    folded = (w[:-1] * (idf / scale)[:, None]).astype(np.float32)
    model = Model(languages, folded, w[-1].copy(), 1.0, idf.astype(np.float32), MARGIN * max(surprises(rows, idf)))
    if apart:
        raw = np.array([w[-1] + (tf * idf[f] / scale) @ w[f] for _, f, tf in apart])
        gold = np.array([languages.index(r[0]) for r in apart])
        model.temperature = float(min(TEMPERATURES, key=lambda t: losses(raw, gold, t).mean()))
    return model


#: Kinds of the rows of ``learned``.
TAUGHT, APART, SURPRISE = 0, 1, 2


def learned(keyed: DataFrame, languages: list[str], idf: np.ndarray, shards: int, epochs: int = EPOCHS) -> DataFrame:
    """kind, at, and the sums ``weighted`` and ``n``, with a value a language.  Over the shards of
    either kind (``apart`` or not): each feature's weights times their squared gradients, and
    these, in UNITs; ``at`` is the feature (one more: the bias).  Under SURPRISE the number of
    texts whose surprise is ``at`` thousandths, rounded up."""
    sent = keyed.sparkSession.sparkContext.broadcast((languages, idf))

    def run(batches):
        languages, idf = sent.value
        size, k = len(idf) + 1, len(languages)
        total = [[np.zeros((size, k), np.int64) for _ in range(2)] for _ in range(2)]
        surprise: Counter = Counter()
        fold = np.append(idf, 1.0)[:, None]
        block: list[tuple[str, np.ndarray, np.ndarray]] = []
        held, current, last = 0, None, None

        def learn() -> None:
            w, n, scale = ftrl(block, languages, idf, epochs)
            weighted, own = total[current[1]]
            at = np.flatnonzero(n.any(axis=1))
            folded = w[at] * fold[at]
            folded[at < size - 1] /= scale
            weighted[at] += np.rint(n[at] * folded / UNIT).astype(np.int64)
            own[at] += np.rint(n[at] / UNIT).astype(np.int64)
            surprise.update(np.ceil(1000 * np.array(surprises(block, idf))).astype(int).tolist())
            block.clear()

        for batch in batches:
            for shard, apart, key, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, lang) == last:
                    continue
                last = (key, lang)
                if (own := grams(text)) is None:
                    continue
                found = term_frequencies(own)
                if block and ((shard, apart) != current or held + len(found[0]) > BLOCK_FEATURES):
                    learn()
                    held = 0
                current = (shard, apart)
                block.append((lang, *found))
                held += len(found[0])
        if block:
            learn()
        kind, at, weighted, own = [], [], [], []
        for which, (ww, nn) in enumerate(total):
            used = np.flatnonzero(nn.any(axis=1))
            kind.append(np.full(len(used), which))
            at.append(used)
            weighted.append(ww[used])
            own.append(nn[used])
        if surprise:
            kind.append(np.full(len(surprise), SURPRISE))
            at.append(np.array(list(surprise)))
            own.append(np.zeros((len(surprise), k), np.int64))
            own[-1][:, 0] = list(surprise.values())
            weighted.append(np.zeros((len(surprise), k), np.int64))
        columns = [np.concatenate(kind), np.concatenate(at), *np.concatenate(weighted).T, *np.concatenate(own).T]
        for first in range(0, len(columns[0]), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[first : first + 4096]), pa.int64()) for c in columns], names)

    sums = [f"w{i}" for i in range(len(languages))] + [f"n{i}" for i in range(len(languages))]
    names = ["kind", "at", *sums]
    dealt = keyed.select(F.pmod("key", F.lit(shards)).alias("shard"), "apart", "key", "lang", "text")
    dealt = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "apart", "key", "lang")
    return map_task(dealt, run, ", ".join(f"{c} long" for c in names)).groupBy("kind", "at").agg(*(F.sum(c).alias(c) for c in sums))


def calibrated(apart: DataFrame, model: Model) -> float:
    """The temperature, of a fine grid, at which the model predicts these rows best."""
    sent = apart.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        sums = np.zeros(len(TEMPERATURES), np.int64)
        for batch in batches:
            found = [(lang, own) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (own := grams(text)) is not None]
            if found:
                raw = np.array([model.scores(own) for _, own in found])
                gold = np.array([model.languages.index(lang) for lang, _ in found])
                sums += np.array([np.rint(losses(raw, gold, t) / UNIT).astype(np.int64).sum() for t in TEMPERATURES])
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "loss"])

    found = dict(map_task(apart.select("lang", "text"), run, "at long, loss long").groupBy("at").agg(F.sum("loss")).collect())
    return float(TEMPERATURES[min(found, key=lambda k: (found[k], k))]) if found else 1.0


def train_all(training: DataFrame, languages: list[str], idf: np.ndarray, texts: int) -> Model:
    """A model from all rows of ``training`` (doc_id, text, lang), ``texts`` of which have a letter."""
    size, k = len(idf) + 1, len(languages)
    key = F.xxhash64("doc_id", "text")
    apart = (F.pmod(F.shiftright("key", 32), F.lit(CALIBRATION_EVERY)) == 0).cast("int") if texts >= 20 else F.lit(0)
    keyed = training.select("lang", "text", key.alias("key")).withColumn("apart", apart)
    sums = np.zeros((2, 2, size, k))
    found = np.array(learned(keyed, languages, idf, -(-texts // SHARD_ROWS)).toArrow().columns)  # at most two rows a feature
    kinds, places, values = found[0], found[1], found[2:].T.reshape(-1, 2, k)
    for kind in (TAUGHT, APART):
        own = kinds == kind
        sums[kind][:, places[own]] = values[own].transpose(1, 0, 2)
    own = kinds == SURPRISE
    surprise = dict(zip(places[own].tolist(), values[own, 1, 0].tolist(), strict=True))

    def mean(weighted: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.divide(weighted, n, out=np.zeros_like(n), where=n > 0)
        return w[:-1].astype(np.float32), w[-1]

    above, most = 0, max(surprise)
    for at in sorted(surprise, reverse=True):
        most = at
        above += surprise[at]
        if above > sum(surprise.values()) // OUTLIERS:
            break
    temperature = 1.0
    if sums[APART].any() and sums[TAUGHT].any():
        temperature = calibrated(keyed.where("apart = 1"), Model(languages, *mean(*sums[TAUGHT]), 1.0))
    return Model(languages, *mean(*sums.sum(axis=0)), temperature, idf.astype(np.float32), MARGIN * most / 1000)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int | None = None) -> Model | None:
    """A model from the labelled rows that are not held out, all of them unless ``sample_rows``
    is given; None if there are none."""
    training = _slim(docs, id_col, text_col, lang_col).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts, n, languages = statistics(training)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + counts)) + 0.05
    return train_all(training, languages, idf, n) if sample_rows is None else train(sample(training, sample_rows), idf)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", surprise_col: str | None = None) -> DataFrame:
    """``docs`` with two or three columns more.  The model, of bounded size, goes to all tasks."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("pred string, score double, surprise double")
    def scored(texts):
        import pandas as pd

        model = sent.value
        pred, score, surprise = [], [], []
        for text in texts:
            own = None if text is None or model is None else grams(text)
            if own is None:
                pred.append(UNDETERMINED)
                score.append(0.0)
                surprise.append(None)
            else:
                p = model.probabilities(own)
                at = int(p.argmax())
                pred.append(model.languages[at])
                score.append(float(p[at]))
                surprise.append(model.surprise(own))
        return pd.DataFrame({"pred": pred, "score": score, "surprise": pd.Series(surprise, dtype=float)})

    found = "__tessella_language"
    return docs.withColumn(found, scored(F.col(text_col).cast("string"))).withColumns({name: F.col(f"{found}.{c}") for c, name in (("pred", pred_col), ("score", score_col), ("surprise", surprise_col)) if name}).drop(found)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and surprise of every document."""
    model = fit(docs, id_col, text_col, lang_col, sample_rows)
    slim = inputs(docs, doc_id=id_col, text=text_col)
    return predict(slim, model, surprise_col="surprise").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "surprise")


def keep_identified(docs: DataFrame, languages: list[str] | None = None, least_score: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in a learned language: those with a letter, a score of
    ``least_score`` or more (by default likelier than chance), a surprise within what the
    training texts bear out and, if given, one of ``languages``."""
    pred, score, surprise = "__tessella_pred", "__tessella_score", "__tessella_surprise"
    model = fit(docs, id_col, text_col, lang_col)
    scored = predict(docs, model, text_col, pred, score, surprise)
    # of one language alone all texts are; a score can't exceed chance there
    chance = 1 / len(model.languages) if model is not None and len(model.languages) > 1 else 0.0
    likely = F.col(score) > chance if least_score is None else F.col(score) >= least_score
    wanted = (F.col(pred) != UNDETERMINED) & likely
    if model is not None and np.isfinite(model.most_surprise):
        wanted = wanted & (F.col(surprise) <= model.most_surprise)
    if languages is not None:
        wanted = wanted & F.col(pred).isin(languages)
    return scored.where(wanted).select(*(F.col(f"`{c}`") for c in docs.columns))
