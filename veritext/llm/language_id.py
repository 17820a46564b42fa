"""Language identification (operator 2).

A sparse multinomial logistic regression on TF-IDF character n-grams (1 to 3 code points of the
lower-cased text, all ten digits as one character), trained with FTRL-proximal under an elastic net (McMahan et al., 2013), then
calibrated by a temperature on rows that the training didn't see. The temperature is fitted to smoothed
labels, so it stays finite, and isn't below 1, where no row is wrong.

* N-grams are hashed to ``FEATURES`` numbers (65,536). Two n-grams that share a number share its counts
  and weight. The texts of a few languages hold some ten thousand different n-grams, so most numbers
  that a text uses are its own; with scripts of many characters rare n-grams share more of them.

* Document frequencies are counted over every learnable document (a map-side vector for each
  task, then a grouped sum of at most ``features`` rows).
* The weights are fitted on a bounded sample of labelled rows: ``sample`` rows for each language
  (default 800), ``total`` in all (default 20,000) and ``mb`` megabytes of features in all (default 128),
  each language its even share, in the order of a hash of the id. A row is learnt from with all its n-grams. The
  ``languages`` most frequent values (default 256) are learnt. These are the documented bounds of the fit.
* tf is the share that an n-gram has in its document, so a score is a mean of weights over the
  positions of the whole text, taken by table lookup; long texts are read in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import materialise, small_batches

BITS = 16
FEATURES = 1 << BITS
SLICE = 1 << 20
_MANY = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a text, digits 0 to 9 as one, a slice at a time (with two characters of the one before)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    points = np.where((points >= 48) & (points <= 57), np.uint32(48), points)  # which number it is says nothing of a language
    shift = np.uint32(32 - BITS)
    for i in range(0, len(points), SLICE):
        c = points[max(0, i - 2) : i + SLICE]
        new = min(i, 2)
        h = c * _MANY[0]
        one = h ^ (h >> np.uint32(15))
        two = one[:-1] * _MANY[1] + one[1:]
        two ^= two >> np.uint32(13)
        three = two[:-1] * _MANY[2] + one[2:]
        three ^= three >> np.uint32(16)
        for part in (one[new:], two[max(new - 1, 0) :], three):
            part *= _MANY[0]
        yield np.concatenate([one[new:], two[max(new - 1, 0) :], three]) >> shift


def _counts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct features, how often each occurs, and their total."""
    total = np.zeros(FEATURES, dtype=np.int64)
    for g in grams(text):
        total += np.bincount(g, minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at], int(total.sum())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(FEATURES, dtype=np.int64), 0
    seen = np.zeros(FEATURES, dtype=bool)
    for b in batches:
        for t in b.column("text"):
            seen[:] = False
            for g in grams(t.as_py()):
                seen[g] = True
            df += seen
            docs += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], docs), pa.int64())], names=["feature", "n"]
    )


def _features(idf: np.ndarray):
    """Whole texts to their features and TF-IDF values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, values = [], []
            for t in b.column("text").to_pylist():
                at, n, total = _counts(t)
                x = n / max(total, 1) * idf[at]
                places.append(at.astype("<i4").tobytes())
                values.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("r"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["lang", "r", "at", "x"]
            )

    return run


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, features: int,
    epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases by FTRL-proximal; rows are (feature numbers, values)."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            at, x = np.append(at, features), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[k]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(features + 1))
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss (golden section on its logarithm) against smoothed labels.

    Of n rows each label keeps all but 1 / (n + 2), which is shared by all classes; so even rows that are
    all told apart have a best temperature, which isn't taken below 1.
    """
    n, k = scores.shape
    rest = 1 / (n + 2)

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        logp = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return float(-np.mean((1 - rest) * logp[np.arange(n), labels] + rest * logp.mean(axis=1)))

    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    found = float(np.exp((lo + hi) / 2))
    return max(found, 1.0) if (scores.argmax(axis=1) == labels).all() else found


class Model:
    """Table of weight times idf for each feature, biases and a temperature."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.table, self.bias, self.temperature = langs, table.astype(np.float32), bias, temperature

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text):
            total += self.table[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(n, 1) * SCALE + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        s = self.scores(text) / self.temperature
        p = np.exp(s - s.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


SCALE = 100.0


def train(
    learn: DataFrame, sample: int = 800, total: int = 20_000, mb: float = 128, languages: int = 256, seed: str = "lang-1"
) -> Model | None:
    """A model from rows (id, text, lang), none of them null. Without rows: None."""
    text = learn.filter("text <> ''").select("text")
    df = np.zeros(FEATURES, dtype=np.int64)
    docs = 0
    for row in text.mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if row.feature < 0:
            docs = row.n
        else:
            df[row.feature] = row.n
    rank = F.xxhash64(F.lit(seed), "id")
    counts = {r.lang: r["count"] for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts or not docs:
        return None
    langs = sorted(counts)
    sample = max(1, min(sample, total // len(langs)))
    # a little more than the sample by a hash threshold, so that no language is ranked in one task; then the exact bounds
    share = F.create_map(*[x for la in langs for x in (F.lit(la), F.lit(min(1.0, 1.3 * sample / counts[la])))])
    near = learn.withColumn("r", rank).filter(F.pmod("r", F.lit(1 << 20)) / float(1 << 20) < F.element_at(share, F.col("lang")))
    idf = np.log((1 + docs) / (1 + df)) + 1
    rows = materialise(near.select("lang", "r", "text").mapInArrow(_features(idf), "lang string, r long, at binary, x binary"), "op2-rows")
    order = Window.partitionBy("lang").orderBy("r", "at")
    before = F.coalesce(F.sum(F.octet_length("at") + F.octet_length("x")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("before", before)
    got = rows.filter((F.col("nth") <= sample) & (F.col("before") < mb * (1 << 20) / len(langs))).drop("before").collect()
    got.sort(key=lambda x: (x.lang, x.nth))
    rows, labels, held, held_labels = [], [], [], []
    number = {la: k for k, la in enumerate(langs)}
    for x in got:
        at = np.frombuffer(x.at, dtype="<i4").astype(np.int64)
        values = np.frombuffer(x.x, dtype="<f4").astype(np.float64) * SCALE
        apart = x.nth % 5 == 0
        (held if apart else rows).append((at, values))
        (held_labels if apart else labels).append(number[x.lang])
    w, bias = fit_ftrl(rows, np.array(labels), len(langs), FEATURES)
    scores = np.array([x @ w[at] + bias for at, x in held]).reshape(len(held), len(langs))
    temperature = fit_temperature(scores, np.array(held_labels)) if held else 1.0
    return Model(langs, w * idf[:, None], bias, temperature)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for t, letters in zip(b.column("text").to_pylist(), b.column("letters").to_pylist()):
                found = model.predict(t) if letters and model else ("und", 0.0)
                lang.append(found[0])
                score.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame,
    learnable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 800,
) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, lang_pred, score.

    ``learnable`` says which rows may teach; of them those with a language and a text do.
    Predictions look at the text alone.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
    where nothing can be learnt. One language only: it is predicted with score 1. Equal scores (ties): the
    language that sorts first. Null ids are carried on and, where ``learnable`` is null, neither taught from
    nor held out. Rows that repeat are judged alike. Very long texts are read whole, a slice at a time. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        learnable.alias("learnable"),
    )
    model = train(base.filter("learnable and text is not null and lang is not null").select("id", "text", "lang"), sample)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = base.select("id", F.coalesce(~F.col("learnable"), F.lit(False)).alias("held_out"), "text", letters.alias("letters"))
    out = rows.mapInArrow(_predict(model), "id long, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
