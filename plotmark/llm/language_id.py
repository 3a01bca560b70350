"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

ORDERS, BUCKETS = 3, 1 << 15  # n-grams of 1 to ORDERS letters, hashed
LANGUAGES = 128  # of the labels those with most rows, which a model learns at most
SAMPLE = 6_000  # labelled rows that the fit sees at most, alike many of each language
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-5
UNDETERMINED = "und"
CHUNK = 1 << 20  # characters that are hashed at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the whole text, lower-cased, all but letters being one space; None
    without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[np.minimum(code, 0x10FFFF)]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of what follows a letter stands for the space
    code = np.concatenate([[32], np.where(letter, code, 32)[keep], [32]]).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for i in range(0, len(code), CHUNK):
        part = code[i : i + CHUNK + ORDERS - 1]
        h = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, ORDERS + 1):
            own = len(part) - n + 1
            if own <= 0:
                break
            h = (h[:own] + part[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            some = min(own, CHUNK)
            counts += np.bincount((h[:some] * np.uint32(0x85EBCA77)) >> np.uint32(17), minlength=BUCKETS)
    return counts


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / np.sqrt((x * x).sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


@dataclass
class LanguageModel:
    """Languages, inverse document frequencies, weights (buckets by languages) and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if self.languages else None
        if counts is None:
            return UNDETERMINED, 0.0
        at, x = _features(counts, self.idf)
        p = _softmax(x @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-proximal updates with L1 and L2 penalties."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at) -> np.ndarray:
        own = z[at]
        return -np.sign(own) * np.maximum(np.abs(own) - L1, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, label = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm. One more row, wrongly
    labelled, is supposed, so that a few rows without an error can't promise certainty."""

    doubt = 1 / (1 + len(logits))

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        right = (1 - doubt) * s[np.arange(len(s)), labels] + doubt * s.mean(axis=1)
        return float((np.log(np.exp(s).sum(axis=1)) - right).mean())

    lo, hi, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit_language_model(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> LanguageModel:
    """Learn from the rows of ``labelled`` that have a language and letters.

    Document frequencies are counted over all of them (one array of ``BUCKETS`` counts leaves each task); the
    weights are fitted to at most ``sample`` rows, chosen by the hash of their ids so that languages have alike
    many, of which every fifth is kept for the temperature. Without rows the model knows no language. Of labels the
    ``languages`` with most rows are learnt (of equally many those first by name), so that the model's size doesn't follow the
    number of unlike labels, such as misspelt ones; rows with other labels count as text only.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    of = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    total = counts.agg(F.sum("n")).first()[0]
    languages = sorted(of)
    if not languages:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if (counts := ngram_counts(text)) is not None:
                    total += counts > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    idf = np.full(BUCKETS, 0.0)
    for r in counted:
        idf[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + idf)) + 1

    share = F.try_element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, sample / len(languages) / of[k])]), F.col("lang"))
    order = F.xxhash64("doc_id")
    chosen = rows.withColumn("order", order).filter(F.col("lang").isin(languages)).filter(F.pmod("order", F.lit(1 << 20)) < share * (1 << 20))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ngram_counts(t) for t in b.column(1).to_pylist()]
            packed = [None if c is None else np.concatenate([a := np.flatnonzero(c), c[a]]).astype(np.int32).tobytes() for c in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(packed, pa.binary())], ["doc_id", "lang", "order", "counts"])

    drawn = chosen.mapInArrow(featured, "doc_id string, lang string, order long, counts binary").filter("counts is not null").orderBy("order", "doc_id").limit(sample).collect()
    fit, rest = [], []
    for i, r in enumerate(drawn):
        at, n = np.frombuffer(r["counts"], dtype=np.int32).reshape(2, -1)
        counts = np.zeros(BUCKETS, dtype=np.int64)
        counts[at] = n
        (rest if i % 5 == 4 else fit).append((*_features(counts, idf), languages.index(r["lang"])))
    weights = train_ftrl(fit, len(languages))
    temperature = fit_temperature(np.array([x @ weights[at] for at, x, _ in rest]), np.array([k for *_, k in rest])) if rest else 1.0
    return LanguageModel(languages, idf, weights, temperature)


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the calibrated probability) of the whole ``text_col``, replacing columns of
    those names. Null text and text without letters is ``und`` with score 0; rows stay as they are, repeated or not."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            got = [model.predict(t) for t in b.column(at).to_pylist()]
            more = [pa.array([k for k, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, "lang_pred", "score"])

    kept = docs.select(*names)
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves a remainder of 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    return predict_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
