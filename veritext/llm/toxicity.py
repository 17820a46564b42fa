"""Toxicity by non-negative positive-unlabelled learning (operator 10).

Confirmed toxic documents are the positives; other text is unlabelled, a mixture whose share of
toxic documents is the class prior. A linear numpy classifier is trained on the non-negative risk
estimator (Kiryo et al., 2017): prior * R+(positives) + max(0, R-(unlabelled) - prior *
R-(positives)); where the second part turns negative its gradient is reversed, which keeps the
classifier from fitting the unlabelled rows. The prior is the share of toxic rows among the
learnable labels.

A document is its words and their first 4, 5, 6 and 7 bytes, so that inflected forms share evidence.
The value of each is the square root of its count over the logarithm of the document's words: one word
that looks like an insult weighs less in a long text than several in a short one. The logarithm of
the number of words is a value of its own, whose weight may have either sign; no word speaks against
toxicity. Features are 64-bit hashes and are compared whole, so long texts meet no collisions. Whole texts are read
everywhere.

The fit is bounded: about ``positives`` confirmed rows (default 3,000) and ``unlabelled``
others (default 15,000), both chosen by a hash of the id, and ``mb`` megabytes of their features (default
128, by kind of row, in the order of that hash); of the features that occur in at least 4 of the positives the
``candidates`` most frequent ones (default 200,000) are compared with the unlabelled rows, and the ``kept`` most
significant ones (default 4,000) enter the model. So the driver receives at most 3 MB of candidates and ``mb`` of
rows. A fifth of the positives and about ``clean`` labelled clean rows (default 3,000) set the decision point,
which is mapped to a score of ``cut``. All rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.common import materialise, small_batches

PREFIXES = (4, 5, 6, 7)
SLICE = 1 << 20
_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = True
_WORD[128:] = True
_rng = np.random.default_rng(31)
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UP = np.full(SLICE + 4096, 0xD1342543DE82EF95, dtype=np.uint64)
_UP[0] = 1
_UP = np.multiply.accumulate(_UP)
_DOWN = np.full(SLICE + 4096, pow(0xD1342543DE82EF95, -1, 1 << 64), dtype=np.uint64)
_DOWN[0] = 1
_DOWN = np.multiply.accumulate(_DOWN)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slices(text: str) -> Iterator[np.ndarray]:
    """The lower-cased bytes of a text, cut where no word is parted (a run of letters beyond 4,000 bytes may be)."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    at = 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        if end < len(raw):
            gap = np.flatnonzero(~_WORD[raw[end - 4000 : end]])
            end = end - 4000 + int(gap[-1]) + 1 if len(gap) else end
        yield raw[at:end]
        at = end


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct 64-bit hashes of words and word beginnings, their counts, and the number of words."""
    parts, words = [], 0
    for b in _slices(text):
        inside = np.concatenate([[False], _WORD[b], [False]])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turn[::2], turn[1::2]
        words += len(start)
        upto = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * _UP[: len(b)], out=upto[1:])
        down = _DOWN[start]
        parts.append(_mix((upto[end] - upto[start]) * down))
        for p in PREFIXES:
            longer = end - start > p
            s = start[longer]
            parts.append(_mix((upto[s + p] - upto[s]) * down[longer] + np.uint64(p)))
    found, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), return_counts=True)
    return found, counts, words


class Lookup:
    """Exact search of hashes in a sorted table, behind a small bit filter."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.may = np.zeros(1 << 20, dtype=bool)
        self.may[table >> np.uint64(44)] = True

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of the hashes that are there, and which of ``found`` these are."""
        near = np.flatnonzero(self.may[found >> np.uint64(44)])
        if not len(near) or not len(self.table):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.table, found[near])
        at[at == len(self.table)] = 0
        same = self.table[at] == found[near]
        return at[same], near[same]

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text; the place behind the table holds its length."""
        found, counts, words = features(text)
        at, which = self(found)
        values = np.sqrt(counts[which] / np.log2(2 + words))
        return np.append(at, len(self.table)), np.append(values, np.log2(1 + words) / 8)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to a row for each of their features."""
    for b in batches:
        for t in b.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(features(t)[0].view(np.int64))], names=["f"])


def _emit(table: np.ndarray):
    """Rows to the places of their features in a table, and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(table)
        for b in batches:
            out = [look.row(t) for t in b.column("text").to_pylist()]
            parts = [pa.array([x[k].astype(kind).tobytes() for x in out], pa.binary()) for k, kind in enumerate(("<i4", "<f4"))]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("r"), *parts], names=["kind", "r", "f", "v"])

    return run


def _table_counts(table: np.ndarray):
    """Texts to (place, number of texts that hold it); place -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, n, total = Lookup(table), np.zeros(len(table), dtype=np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                n[look(features(t)[0])[0]] += 1
                total += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(n[at], total), pa.int64())], names=["place", "n"])

    return run


class _Rows:
    """Sparse rows (places, values) in compressed form."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(rows), width
        self.at = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, dtype=np.int64)
        self.value = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
        self.row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]) if rows else np.zeros(0, dtype=np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.value, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row] * self.value, self.width)


def nnpu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the logistic loss, from the decision values of positives and unlabelled rows:
    prior * R+(positives), and R-(unlabelled) - prior * R-(positives), which may not be negative."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def nnpu_slopes(zp: np.ndarray, zu: np.ndarray, prior: float, beta: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Slopes in the decision values: of the whole risk, or, where its second part is below -beta, of that part turned round."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    un_u, un_p = sig(zu) / len(zu), -prior * sig(zp) / len(zp)
    if nnpu_risk(zp, zu, prior)[1] < -beta:
        return -un_p, -un_u
    return -prior * sig(-zp) / len(zp) + un_p, un_u


def fit_nnpu(pos: _Rows, unl: _Rows, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 2e-4, beta: float = 0.0):
    """Weights and bias that minimise the non-negative risk under the logistic loss (Adam, full batches); the last weight is the length's."""
    width = pos.width
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        dp, du = nnpu_slopes(pos.dot(w[:-1]) + w[-1], unl.dot(w[:-1]) + w[-1], prior, beta)
        g = np.append(pos.back(dp) + unl.back(du) + l2 * w[:-1], dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-2] = np.maximum(w[:-2], 0)  # words are evidence for toxicity; none speaks against it
    return w[:-1], float(w[-1])


def decision_point(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1; in the middle of the gap between the rows it parts."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1)


class Model:
    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float, cut: float):
        self.table, self.weights, self.bias, self.cut = table, weights, bias, cut


def train(
    texts: DataFrame, known: DataFrame, positives: int = 3_000, unlabelled: int = 15_000, clean: int = 3_000, candidates: int = 200_000,
    kept: int = 4_000, seed: str = "tox-1", min_docs: int = 4, significance: float = 4.0, mb: float = 128,
) -> Model | None:
    """A model from learnable rows (id, text) and labels (id, toxic). Without both kinds of label, or without any row to set against
    the positives: None.

    The rows of the fit are chosen among ids alone; texts meet the chosen ids only, a list whose
    size the parameters bound, and never move.
    """
    ids = materialise(texts.select("id").distinct().join(known, "id", "left"), "op10-ids")
    size = {(None if r.toxic is None else int(r.toxic)): r["count"] for r in ids.groupBy("toxic").count().collect()}  # three rows
    if not size.get(1) or not size.get(0):
        return None
    prior = size[1] / (size[1] + size[0])
    others = sum(size.values()) - size[1]
    hashed = lambda s: F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(1 << 30)) / float(1 << 30)
    share, apart, part = min(0.8, unlabelled / others), min(1.0, clean / (0.2 * size[0])), min(1.0, positives / size[1])
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    # 1 positives to learn from; 0 unlabelled rows, labelled clean ones among them; apart from them, positives (3) and
    # clean rows (2) for the decision point
    kind = (
        F.when(toxic, F.when(F.col("r") <= part / 5, 3).when(F.col("r") <= part, 1))
        .when(F.col("u") < share, 0)
        .when((F.col("toxic") == 0) & (F.col("u") >= 0.8) & (F.col("r") <= apart), 2)
    )
    chosen = ids.withColumn("r", hashed(seed)).withColumn("u", hashed(seed + "-u")).withColumn("kind", kind).filter("kind is not null")
    chosen = materialise(chosen.select("id", "kind", "r"), "op10-chosen")
    rows = texts.join(F.broadcast(chosen), "id")
    n_teach = chosen.filter("kind = 1").count()
    if not n_teach:
        return None
    # candidates: features of several positives; counted in Spark, the frequent ones only come to the driver
    seen = rows.filter("kind = 1").select("text").mapInArrow(_hashes, "f long").groupBy("f").agg(F.count("*").alias("n"))
    seen = seen.filter(F.col("n") >= min(min_docs, max(1, n_teach // 10))).orderBy(F.desc("n"), "f").limit(candidates).toArrow()
    table, in_pos = seen.column("f").to_numpy().view(np.uint64), seen.column("n").to_numpy().astype(np.float64)
    order = np.argsort(table)
    table, in_pos = table[order], in_pos[order]
    in_other, n_other = np.zeros(len(table)), 0
    other = rows.filter("kind = 0").select("text").mapInArrow(_table_counts(table), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    for x in other.collect():  # as many rows as there are candidates, at most
        if x.place < 0:
            n_other = x.n
        else:
            in_other[x.place] = x.n
    # of the candidates, what is significantly more frequent among positives than in other text
    share_u = (in_other + 0.5) / (n_other + 1)
    excess = (in_pos - n_teach * share_u) / np.sqrt(n_teach * share_u * (1 - share_u) + 1)
    telling = np.flatnonzero((excess > significance) & (in_pos / n_teach > 2 * share_u))
    table = table[np.sort(telling[np.argsort(-excess[telling], kind="stable")[:kept]])]
    got = materialise(rows.select("kind", "r", "text").mapInArrow(_emit(table), "kind int, r double, f binary, v binary"), "op10-rows")
    order = Window.partitionBy("kind").orderBy("r", "f", "v").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("upto", F.sum(F.octet_length("f") + F.octet_length("v")).over(order)).filter(F.col("upto") <= mb * (1 << 18)).collect()
    got.sort(key=lambda x: (x.r, x.f, x.v))
    read = lambda x: (np.frombuffer(x.f, dtype="<i4").astype(np.int64), np.frombuffer(x.v, dtype="<f4").astype(float))
    of_kind = lambda k: [read(x) for x in got if x.kind == k]
    plain, teach = of_kind(0), of_kind(1)
    if not plain or not teach:
        return None
    pos = _Rows(teach, len(table) + 1)
    # the mixture must hold its share of positives: labelled ones were taken out above, so they are put back in proportion
    known_share = size[1] / sum(size.values())
    back = round(len(plain) * known_share / (1 - known_share))
    unl = _Rows(plain + [teach[i % len(teach)] for i in range(back)], len(table) + 1)
    w, bias = fit_nnpu(pos, unl, prior)
    held = of_kind(3)
    at_hand = (held or teach) + of_kind(2)
    y = np.array([1] * len(held or teach) + [0] * (len(at_hand) - len(held or teach)))
    scores = np.array([w[a] @ v + bias for a, v in at_hand])
    return Model(table, w, bias, decision_point(scores, y) if y.min() == 0 else 0.0)


def _score(model: Model | None, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model.table) if model else None
        base = np.log(cut / (1 - cut))
        for b in batches:
            z = np.full(b.num_rows, -40.0)
            if model:
                for i, t in enumerate(b.column("text").to_pylist()):
                    at, values = look.row(t)
                    z[i] = model.weights[at] @ values + model.bias - model.cut + base
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(score)], names=["id", "held_out", "score"])

    return run


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    cut: float = 0.7,
) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted.

    ``labels`` has (id, label); ``learnable`` is a column of ``docs``'s id that says whose labels
    may teach. Scores look at the text alone.

    Defined cases: a null or empty text has the score of a text without words. Several labels of
    one id: toxic if any is. Without labels of both kinds every score is near 0. Null ids have no
    label and aren't held out where ``learnable`` is null. Rows that repeat are judged alike. Very long texts are read whole, a slice at a time. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        learnable.alias("learnable"),
    )
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    model = train(base.filter("learnable and id is not null").select("id", "text"), known)
    rows = base.select("id", F.coalesce(~F.col("learnable"), F.lit(False)).alias("held_out"), "text")
    out = rows.mapInArrow(_score(model, cut), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
