"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; what is no letter becomes a space, runs of spaces one. N-grams of one to three characters
are hashed into ``DIMENSIONS`` buckets. Document frequencies are counted over all training rows, where the data
are. The classifier is fitted on a bounded sample of labelled rows (at most ``SAMPLE_PER_LANG`` for each
language, chosen by a hash of the id) with follow-the-regularised-leader: per-coordinate steps, with the
elastic-net penalties ``L1`` and ``L2``, so most weights are exactly zero. A fifth of that sample is held back to
calibrate a temperature. Prediction reads the whole text, and nothing but the text.

A text that is null or has no letter (of any script) is ``und`` with score 0; so is every text when no row has a label. Null
labels are never learned from. Every row gives one row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import documents, unused

DIMENSIONS = 1 << 15
SAMPLE_PER_LANG = 1500
#: More labels than this are refused: the sample and the weights grow with them.
MOST_LANGS = 500
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.5
#: Below this score the pipeline's stage rejects a document.
LEAST_SCORE = 0.4
_ORDERS = (1, 2, 3)
_tables: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """By code point: its lower case, or a space where it is no letter."""
    if not _tables:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables.append(table)
    return _tables[0]


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and how often each occurs. Both are empty if it has no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _folded()[points]
    space = c == 32
    c = c[~(space & np.concatenate(([True], space[:-1])))] if len(c) else c
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate(([32], c, [32])).astype(np.uint64)
    h, parts = np.zeros(len(c), np.uint64), []
    for n in _ORDERS:
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        parts.append((x >> np.uint64(64 - 15)).astype(np.int64))
    counts = np.bincount(np.concatenate(parts), minlength=DIMENSIONS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's TF-IDF vector, of length one."""
    at, counts = buckets(text)
    values = (1 + np.log(counts)) * idf[at] if len(at) else np.zeros(0)
    return at, values / (np.linalg.norm(values) or 1.0)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMENSIONS + 1 rows, the last for the bias
    temperature: float

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs:
            return "und", 0.0
        at, values = vector(text, self.idf)
        if not len(at):
            return "und", 0.0
        p = softmax(self.logits(at, values) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def training(doc_id: Column, lang: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0) & lang.isNotNull()


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """By bucket, in how many texts it occurs; and the number of texts. A task sends one row for each bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, texts = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                met[buckets(text)[0]] += 1
                texts += 1
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(met[at], texts))], ["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, texts = np.zeros(DIMENSIONS), 0
    for bucket, n in rows:  # at most DIMENSIONS + 1 rows
        if bucket < 0:
            texts = n
        else:
            out[bucket] = n
    return out, texts


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights by bucket and class; the bias is the last row and bears no penalty."""
    z, squares = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, scale = z[at], (BETA + np.sqrt(squares[at])) / ALPHA
        free = (at == DIMENSIONS)[:, None]
        l1, l2 = np.where(free, 0.0, L1), np.where(free, 0.0, L2)
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / (scale + l2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            at, values, label = examples[k]
            at, values = np.append(at, DIMENSIONS), np.append(values, 1.0)
            w = weights(at)
            p = softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p
            sigma = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / ALPHA
            z[at] += g - sigma * w
            squares[at] += g * g
    return weights(np.arange(DIMENSIONS + 1))


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """The model of the rows whose crc32(id as text) is not divisible by 5 and whose label is not null."""
    rows = docs.where(training(F.col(id_col), F.col(lang_col)))
    counts = dict(rows.groupBy(lang_col).count().limit(MOST_LANGS + 1).collect())
    if len(counts) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    if not counts:
        return Model([], np.zeros(DIMENSIONS), np.zeros((DIMENSIONS + 1, 0)), 1.0)
    frequencies, texts = document_frequencies(rows, text_col)
    idf = np.log((1 + texts) / (1 + frequencies)) + 1
    langs = sorted(counts)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, 1.5 * per_lang / counts[lang]))]), F.col(lang_col))
    drawn = rows.withColumn("_key", F.xxhash64(F.col(id_col).cast("string"), F.lit(7))).where(F.pmod("_key", F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(t, idf) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], ["_key", "lang", "at", "v"])

    sample = drawn.select("_key", lang_col, text_col).mapInArrow(run, "_key long, lang string, at array<int>, v array<float>").toArrow().combine_chunks()
    keys, names = sample.column("_key").to_pylist(), sample.column("lang").to_pylist()
    lists = [sample.column(c).combine_chunks() for c in ("at", "v")]
    ends = [0, *np.cumsum(lists[0].value_lengths().to_numpy()).tolist()]
    at, v = (x.flatten().to_numpy() for x in lists)
    by_lang: dict[str, int] = {}
    learn, held = [], []
    for i in sorted(range(len(keys)), key=lambda i: (keys[i], names[i], ends[i])):
        k = by_lang[names[i]] = by_lang.get(names[i], 0) + 1
        if k <= per_lang and ends[i] < ends[i + 1]:
            (held if k % 5 == 0 else learn).append((at[ends[i] : ends[i + 1]], v[ends[i] : ends[i + 1]], langs.index(names[i])))
    weights = ftrl(learn, len(langs))
    model = Model(langs, idf, weights, 1.0)
    model.temperature = calibrated(np.array([model.logits(a, v) for a, v, _ in held]), np.array([k for _, _, k in held], dtype=np.int64))
    model.weights = weights.astype(np.float32)
    model.idf = idf.astype(np.float32)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds ``pred`` and ``score`` to every row."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(text_col).to_pylist()]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *more], [*names, pred, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def rejecting(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, with their columns, whatever their names.

    Null and empty texts and texts without letters go; if no row has a label, all go. Repeated rows are judged alike."""
    names = docs.columns
    pred, score = unused(names, "lang_pred", "score")
    known = identify(docs, fit(docs), pred=pred, score=score)
    return known.where((F.col(pred) != "und") & (F.col(score) >= least)).select(*names)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
