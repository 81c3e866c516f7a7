"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are hashed into a table of embeddings; filters of several widths slide over the words of the whole text; each
filter's highest response over the text (max pooling, so one abusive phrase in a long text counts fully) goes through a
logistic layer. Words that fewer than MIN_DOCS training texts hold share the zero vector, so that the network can't learn
documents by their rare words. Training looks at a bounded sample of labelled rows (MAX_POSITIVE, MAX_NEGATIVE, MAX_WORDS),
hashed where they lie and fitted in one task from 32-bit numbers; the driver only sees the fitted arrays. Thresholds come from
every other labelled row; scoring reads every whole text. Text is all that a score depends on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corvane.llm.common import drop, fold_of, fresh, materialize, released, table

#: Words are hashed to this many buckets; only buckets that training kept have an embedding, so a rare word rarely meets one.
BUCKETS = 1 << 32
DIMS = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Rows of either label that training may use: those whose seeded hash is smallest.
MAX_POSITIVE, MAX_NEGATIVE = 2500, 5000
#: Words of the sample that training may use: rows in the order of their hash, as long as they fit.
MAX_WORDS = 8_000_000
MIN_DOCS = 4
EPOCHS = 5
#: Texts of a step of training, and words of a step that holds more than one text.
STEP_TEXTS, STEP_WORDS = 64, 100_000
#: One in so many rows of the sample takes no part in training, so that small tables have rows to calibrate thresholds.
APART = 5
#: Languages with fewer calibration rows use the threshold over all languages.
MIN_CALIBRATION = 40
#: So do languages with fewer rows of either label; where all rows together have fewer, the threshold is 0.5.
MIN_OF_LABEL = 10
#: Bins of scores from which thresholds are chosen.
BINS = 4096
SEED = 11
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words whose number a task remembers.
MEMO = 100_000


class Words:
    """Texts to bucket numbers, or, given the kept buckets, to rows of the embeddings (0: not kept)."""

    def __init__(self, keys: np.ndarray | None = None):
        self.memo: dict[bytes, int] = {}
        self.rows = None if keys is None else {k: i + 1 for i, k in enumerate(keys.tolist())}

    def ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the length of each text)."""
        import xxhash

        if len(self.memo) > MEMO:
            self.memo.clear()
        words, lengths = [], []
        for text in texts:
            own = text.translate(PLAIN).split() if text else []
            words += own
            lengths.append(len(own))
        ids = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(ids < 0).tolist():
            found = self.memo.get(words[i])
            if found is None:
                found = xxhash.xxh32_intdigest(words[i], SEED) % BUCKETS
                found = self.memo[words[i]] = found if self.rows is None else self.rows.get(found, 0)
            ids[i] = found
        return ids, np.array(lengths, np.int64)


def prior(texts: list[np.ndarray], labels: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Embeddings to start from: the first coordinate is a word's log odds of the labels over training texts, drawn to
    zero by two standard errors so that rare words start near it; the others are small noise. Row 0 is zero."""
    count = np.zeros((2, len(noise)))
    for t, y in zip(texts, labels, strict=True):
        count[int(y), np.unique(t)] += 1
    total = np.bincount(labels.astype(int), minlength=2)
    odds = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
    error = np.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5))
    E = noise.copy()
    E[:, 0] = np.sign(odds) * np.maximum(0, np.abs(odds) - 2 * error)
    E[0] = 0
    return E


class Network:
    """Embeddings E, one matrix for each width and place in the filter, biases, and the logistic layer."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.keys = np.zeros(0, np.int64)
        self.E = np.zeros((1, DIMS), np.float32)
        self.W = [(r.standard_normal((w, DIMS, FILTERS)) / np.sqrt(w * DIMS)).astype(np.float32) for w in WIDTHS]
        for W in self.W:
            W[0][0, : FILTERS // 2] = 1.0  # half of the filters begin as detectors of the first coordinate
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = np.tile(np.arange(FILTERS) < FILTERS // 2, len(WIDTHS)) * 0.1 + (0.01 * r.standard_normal(FILTERS * len(WIDTHS))).astype(np.float32)
        self.c = np.float32(-1.0)

    def pool(self, ids: np.ndarray, lengths: np.ndarray, where: bool = False):
        """Highest response of each filter over each text; `where`: also the places of the highest. Texts shorter than a filter are padded with zero words."""
        pad = max(WIDTHS) - 1
        starts = np.cumsum(lengths + pad) - (lengths + pad)
        flat = np.zeros(int((lengths + pad).sum()), np.int64)
        inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(ids))
        flat[inside] = ids
        x = self.E[flat]
        out, places = [], []
        bounds = starts.tolist() + [len(flat)]
        for w, W, b in zip(WIDTHS, self.W, self.b, strict=True):
            y = x @ W[0]
            for k in range(1, w):
                y[:-k] += (x @ W[k])[k:]
            y += b
            # A filter that would reach into the next text can only lie in the padding; the last w-1 places are left out.
            if w > 1:
                ends = np.array(bounds[1:])
                for k in range(1, w):
                    y[ends - k] = -1e9
            top = np.maximum.reduceat(y, starts, axis=0)
            out.append(np.maximum(top, 0))
            if where:
                at = np.empty(top.shape, np.int64)
                for i in range(len(lengths)):
                    at[i] = bounds[i] + np.argmax(y[bounds[i] : bounds[i + 1]], axis=0)
                places.append(at)
        return np.concatenate(out, axis=1), flat, places

    def rows_of(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(buckets), np.int64)
        at = np.minimum(np.searchsorted(self.keys, buckets), len(self.keys) - 1)
        return np.where(self.keys[at] == buckets, at + 1, 0).astype(np.int32)

    def scores(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h, _, _ = self.pool(ids, lengths)
        return 1 / (1 + np.exp(-np.clip((h @ self.v + self.c).astype(np.float64), -30, 30)))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
        """Of the mean log loss: by W, b and v, by c, and by the rows of E that count, as (rows, gradients)."""
        lengths = np.array([len(t) for t in texts], np.int64)
        h, flat, places = self.pool(np.concatenate(texts), lengths, where=True)
        p = 1 / (1 + np.exp(-np.clip(h @ self.v + self.c, -30, 30)))
        d = (p - labels) / len(texts)
        dh = np.outer(d, self.v) * (h > 0)
        grads, rows, parts = [], [], []
        for j, (w, W) in enumerate(zip(WIDTHS, self.W, strict=True)):
            g = dh[:, j * FILTERS : (j + 1) * FILTERS]
            gw = np.zeros_like(W)
            for k in range(w):
                words = flat[np.minimum(places[j] + k, len(flat) - 1)]
                gw[k] = np.einsum("if,ifd->df", g, self.E[words])
                rows.append(words.ravel())
                parts.append((g[:, :, None] * W[k].T[None]).reshape(-1, DIMS))
            grads.append(gw)
        grads += [dh[:, j * FILTERS : (j + 1) * FILTERS].sum(axis=0) for j in range(len(WIDTHS))]
        grads.append(h.T @ d)
        rows_all, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        ge = np.zeros((len(rows_all), DIMS), np.float32)
        np.add.at(ge, inverse, np.concatenate(parts))
        return grads, float(d.sum()), rows_all, ge

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.03, seed: int = SEED, odds: bool = True) -> None:
        """AdaGrad on the log loss. Only the places of the highest responses have a gradient. Without `odds`, embeddings and
        filters start at random instead of from prior()."""
        r = np.random.default_rng(seed)
        if not len(texts) or labels.min() == labels.max():
            self.c, self.v[:] = np.float32(0 if not len(texts) else 4 * labels[0] - 2), 0
            return
        found, seen = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
        self.keys = found[seen >= MIN_DOCS]
        texts = [self.rows_of(t) for t in texts]
        noise = (0.02 * r.standard_normal((len(self.keys) + 1, DIMS))).astype(np.float32)
        if odds:
            self.E = prior(texts, labels, noise)
        else:
            self.E = noise * 5
            self.E[0] = 0
            self.W = [(r.standard_normal(W.shape) / np.sqrt(W.shape[0] * DIMS)).astype(np.float32) for W in self.W]
            self.v = (0.1 * r.standard_normal(len(self.v))).astype(np.float32)
        params = [*self.W, *self.b, self.v]
        past = [np.full(p.shape, 1e-2, np.float32) for p in params]
        past_e, past_c = np.full(len(self.E), 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            for some in _steps(r.permutation(len(texts)), texts):
                grads, dc, rows, ge = self.gradients([texts[i] for i in some], labels[some])
                grads[-1] = grads[-1] + 1e-5 * self.v
                for p_, g_, s_ in zip(params, grads, past, strict=True):
                    s_ += g_ * g_
                    p_ -= rate * g_ / np.sqrt(s_)
                past_c += dc**2
                self.c -= np.float32(rate * dc / np.sqrt(past_c))
                past_e[rows] += (ge * ge).mean(axis=1)
                self.E[rows] -= rate * ge / np.sqrt(past_e[rows])[:, None]
                self.E[0] = 0


def _steps(order: np.ndarray, texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Runs of the order that are bounded in texts and, but for a single long text, in words."""
    held, size = [], 0
    for i in order:
        if held and (len(held) == STEP_TEXTS or size + len(texts[i]) > STEP_WORDS):
            yield np.array(held)
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    if held:
        yield np.array(held)


def marked(labelled: DataFrame, id_col: str, label: str) -> DataFrame:
    """(__id, label, lang) once for each labelled id: the highest label. A null id, or label beyond 0 and 1, doesn't count; lang is null where there is no such column."""
    lang = F.col("lang") if "lang" in labelled.columns else F.lit(None).cast("string")
    own = labelled.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label"), lang.alias("lang"))
    return own.groupBy("__id").agg(F.max("label").alias("label"), F.min("lang").alias("lang"))


def sample(one: DataFrame, max_positive: int, max_negative: int) -> DataFrame:
    """(__id, label, k, apart) of those rows of marked() with the smallest seeded hash k of their id, of each label at most the given number; `apart` says that a row only calibrates."""
    keyed = one.select("__id", "label", F.xxhash64(F.lit(SEED), "__id").alias("k"))
    parts = [keyed.where(F.col("label") == value).orderBy("k", "__id").limit(most) for value, most in ((1, max_positive), (0, max_negative))]
    place = F.row_number().over(W.partitionBy("label").orderBy("k", "__id"))
    return parts[0].unionByName(parts[1]).withColumn("apart", place % APART == 0)


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, k, text) to (id, label, k, words), words being 32-bit numbers."""
    words = Words()
    for part in parts:
        out = [words.ids([value.as_py()])[0].astype(np.uint32).tobytes() for value in pc.cast(part.column(3), pa.binary())]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.binary())], ["id", "label", "k", "words"])


def _fitter(epochs: int, max_words: int, odds: bool):
    """Fits a network to the rows (label, words) of a task, which come in the order of their hash."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, room = [], [], max_words
        for part in parts:
            for label, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                words = np.frombuffer(raw.as_py(), np.uint32)
                if len(words) <= room:
                    room -= len(words)
                    texts.append(words)
                    labels.append(label)
        network = Network()
        network.fit(texts, np.array(labels, np.float32), epochs, odds=odds)
        texts.clear()
        released()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["network"])

    return run


class Classifier:
    """A trained network, the threshold of each language, and the one for all others."""

    def __init__(self, network: Network, thresholds: dict[str, float], default: float):
        self.network, self.thresholds, self.default = network, thresholds, default


def best_threshold(scores: np.ndarray, labels: np.ndarray, least: int = MIN_OF_LABEL, weights: np.ndarray | None = None) -> float:
    """The middle of the score gap that gives the highest F1; 0.5 where a label has too few rows to tell. weights: rows of each score."""
    w = np.ones(len(scores)) if weights is None else weights
    if min(w[labels == 1].sum(), w[labels == 0].sum()) < least:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], w[order]
    hit = np.cumsum(y * w)
    f1 = 2 * hit / (np.cumsum(w) + hit[-1])
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores can't be told apart
    k = int(np.argmax(f1))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def calibrate(network: Network, one: DataFrame, texts: DataFrame, fitted: DataFrame, id_col: str, text: str) -> Classifier:
    """Thresholds from every labelled row that wasn't fitted, at the share of labels that the table has.

    one: marked(); fitted: (__id), bounded by the sample. Rows are scored where they lie; only counts of BINS score bins by
    language and label reach the driver. A repeated id counts once, a null id never.
    """
    one = one.join(F.broadcast(fitted), "__id", "left_anti")
    own = texts.select(F.col(id_col).alias("__id"), F.col(text).alias("text"))
    scored = score(own, Classifier(network, {}, 0.5)).select("__id", "score").groupBy("__id").agg(F.min("score").alias("score"))
    # Few languages have rows enough for a threshold of their own; others only count in the total.
    binned = one.join(scored, "__id").select("lang", "label", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("lang", "label", "bin").agg(F.count(F.lit(1)).alias("n")).toArrow()
    middle = (counts.column("bin").to_numpy() + 0.5) / BINS
    y, n = counts.column("label").to_numpy().astype(np.float64), counts.column("n").to_numpy().astype(np.float64)
    langs = np.array(counts.column("lang").to_pylist(), object)

    default = best_threshold(middle, y, weights=n)
    thresholds: dict[str, float] = {}
    for lang in {x for x in langs.tolist() if isinstance(x, str)}:
        at = langs == lang
        if n[at].sum() >= MIN_CALIBRATION and min(n[at & (y == 1)].sum(), n[at & (y == 0)].sum()) >= MIN_OF_LABEL:
            thresholds[lang] = best_threshold(middle[at], y[at], weights=n[at])
    return Classifier(network, thresholds, default)


def train(labelled: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, epochs: int = EPOCHS, calibrated: bool = True, max_words: int = MAX_WORDS, odds: bool = True) -> Classifier:
    """labelled: id, text, label (0, 1, or null: ignored) and lang, if any, which only chooses a threshold; the text may be in
    another table `texts` with the same ids. A repeated id counts once: its highest label and the first of its texts by their
    hash. Null ids are never learnt from; null and empty texts have no words. Without rows of both labels every score is a
    constant. Without `calibrated`, for those who only want scores, thresholds are 0.5.

    Ids are chosen without their texts, which are then looked up by a broadcast of the chosen ids, so the corpus is never
    shuffled; what the fitting task reads is bounded by the sample's rows and words.
    """
    spark = labelled.sparkSession
    sources = labelled if texts is None else texts
    one = marked(labelled, id_col, label)
    chosen = materialize(sample(one, max_positive, max_negative), "toxicity-sample")
    own = sources.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    found = own.join(F.broadcast(chosen.where(~F.col("apart")).select("__id", "label", "k")), "__id").select("__id", "label", "k", "__text")
    kind = dict(chosen.dtypes)["__id"]
    hashed = found.mapInArrow(_hashed, f"id {kind}, label int, k long, words binary").groupBy("id").agg(F.min("k").alias("k"), F.min("label").alias("label"), F.min_by("words", F.xxhash64("words")).alias("words"))
    fitted = hashed.repartition(1).sortWithinPartitions("k", "id").select("label", "words").mapInArrow(_fitter(epochs, max_words, odds), "network binary").first()
    network = pickle.loads(fitted["network"]) if fitted else Network()
    if calibrated:
        model = calibrate(network, one, sources, chosen.where(~F.col("apart")).select("__id"), id_col, text)
    else:
        model = Classifier(network, {}, 0.5)
    drop(spark, chosen)
    return model


def score(docs: DataFrame, model: Classifier, text: str = "text", words_at_once: int = 200_000, into: str = "score") -> DataFrame:
    """docs with the score added as `into` (a column of that name is replaced). Null and empty texts get the score of a text
    without words; repeated rows, and rows with a null id, are scored like any other; a text of any length is read whole."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.network)
    # A text that stays in its own column goes to Python once.
    kept, own = docs.drop(into), fresh("text", docs.columns)
    names, sent = kept.columns, kept if text in kept.columns else docs.withColumn(own, F.col(text)).drop(into)
    place = sent.columns.index(text if text in kept.columns else own)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shipped.value
        words = Words(network.keys)
        for part in parts:
            column = pc.cast(part.column(place), pa.binary())
            found: list[np.ndarray] = []
            held, size = [], 0
            for value in column:
                raw = value.as_py()
                held.append(raw)
                size += len(raw or b"")
                if size > 6 * words_at_once:
                    found.append(network.scores(*words.ids(held)))
                    held, size = [], 0
            if held:
                found.append(network.scores(*words.ids(held)))
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(scores, pa.float64())], [*names, into])
            part = column = value = raw = None
        released()

    schema = StructType([*kept.schema.fields, StructField(into, DoubleType())])
    return sent.mapInArrow(run, schema)


def flag(scored: DataFrame, model: Classifier, score_col: str = "score", into: str = "rejected") -> DataFrame:
    """Adds `into`: the score reaches the threshold of the row's language. Where lang is missing, null or has no threshold of its own, the common one holds; a null score isn't rejected."""
    limit = F.lit(model.default)
    for lang, value in model.thresholds.items() if "lang" in scored.columns else ():
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return scored.withColumn(into, F.coalesce(F.col(score_col) >= limit, F.lit(False)))


def clean(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The rows of docs, in their own columns, that aren't rejected."""
    mark, gone = fresh("score", docs.columns), fresh("rejected", docs.columns)
    return flag(score(docs, model, text, into=mark), model, mark, gone).where(~F.col(gone)).select(*[F.col(f"`{c}`") for c in docs.columns])


def train_on_tables(docs: DataFrame, labels: DataFrame, calibrated: bool = True) -> Classifier:
    """Learns from the labelled documents outside the held-out fold. Repeated label rows of a document count once, as the
    highest; labels of null ids, null labels and labels of other documents don't count. Empty tables give a constant score."""
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.where(fold_of(F.col("doc_id")) != 0)
    lang = [F.col("lang")] if "lang" in docs.columns else []
    return train(own.select("doc_id", *lang).join(marks, "doc_id"), own.select("doc_id", "text"), calibrated=calibrated)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents scored, by a model of the labelled documents outside the held-out fold.
    Nulls, empty and long texts, repeated rows and empty tables as in train_on_tables and score: a row for every row of documents."""
    docs = table(spark, sf_dir, "documents")
    model = train_on_tables(docs, table(spark, sf_dir, "labels"), calibrated=False)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
