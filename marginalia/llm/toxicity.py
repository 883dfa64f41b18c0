"""Toxicity categories by a chain of linear classifiers.

The categories are the label columns, in a given order. The model of each is
a logistic regression over hashed words and the logits of all earlier
categories. In training, the earlier logits come from models that did not see
the document (FOLDS folds), so that later models learn from predictions as
good as those they will meet.

`fit` joins a bounded sample of labelled documents (at most about SAMPLE rows,
by a hash of doc_id) with their whole texts; each becomes the set of its
distinct word buckets on the executors. Of the words that at least
MIN_DOCUMENTS sampled documents have, those count whose share of a category's
documents is off by at least Z_LEAST standard errors, each category having
words of its own; the many others would let a model learn its documents by
heart. Near copies (sets of words that agree in a band of a min-hash
signature) are one in training, or a group of copies with one label would make
all its words look telling. `predict` passes over whole texts.

Cases: null text, or text without words, has no features and gets the chain's
bias; labels that are null are left out; an empty training table, or a
category with one value only, gives that category a constant probability
(0 without labels); ties in probability are not toxic at exactly the
threshold's lower side (`>=` is toxic); rows that share a doc_id are
predicted each on their own; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER, SEPARATOR, Words, batches, ids_of, mix

BUCKET_BITS = 20
SAMPLE = 20_000
FOLDS = 5
MIN_DOCUMENTS = 5
Z_LEAST = 6.0
#: Near copies are sets of words that agree in one of BANDS bands of BAND_ROWS min-hashes.
BANDS, BAND_ROWS = 12, 4
STEPS = 250
RIDGE = 0.02
#: What counts as white space around words here: also the marks of ASCII, but for those that stand in for letters (@ $ *).
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "@$*")


def _split() -> np.ndarray:
    out = LOWER.copy()
    out[list(_MARKS)] = 0x20
    out[SEPARATOR] = 0x20
    return out


FOLD = _split()


def word_buckets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct buckets of the words of each document."""
    words = Words(FOLD[data], bounds)
    b = (words.hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    out = []
    for i, j in zip(words.first.tolist(), words.first.tolist()[1:]):
        s = np.sort(b[i:j])
        out.append(s[np.append(True, s[1:] != s[:-1])] if s.size else s)
    return out


@dataclass
class Model:
    categories: list[str]
    #: kept buckets, ascending
    buckets: np.ndarray
    #: kept buckets x categories
    weights: np.ndarray
    #: categories x categories: weight of an earlier category's logit
    links: np.ndarray
    bias: np.ndarray


class Sparse:
    """A 0/1 matrix: the column and the row of each one."""

    def __init__(self, at: np.ndarray, row: np.ndarray, n: int, width: int):
        self.at, self.row, self.n, self.width = at, row, n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row], self.width)


def _logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, weights of the extra columns and bias; rows that aren't used don't count."""
    n = max(1, int(used.sum()))
    p = float(np.clip((y * used).sum() / n, 1e-4, 1 - 1e-4))
    base = np.log(p / (1 - p))
    w, v, b = np.zeros(x.width), np.zeros(extra.shape[1]), base
    gw, gv, gb = np.zeros_like(w), np.zeros_like(v), 0.0
    if y[used > 0].min(initial=1) == y[used > 0].max(initial=0):
        return w, v, base
    # Adagrad: rare words with a clear meaning get weights as fast as common ones.
    for _ in range(STEPS):
        f = x.dot(w) + extra @ v + b
        g = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y) * used / n
        dw, dv, db = x.back(g) + RIDGE / n * w, extra.T @ g + RIDGE / n * v, float(g.sum())
        gw += dw * dw
        gv += dv * dv
        gb += db * db
        w -= 0.5 * dw / np.sqrt(gw + 1e-16)
        v -= 0.05 * dv / np.sqrt(gv + 1e-16)
        b -= 0.1 * db / np.sqrt(gb + 1e-16)
    return w, v, b


def apart(rows: list[np.ndarray]) -> list[int]:
    """Of each group of near copies the first row: one that shares no band with a row before."""
    rng = np.random.default_rng(11)
    factor = rng.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    seen: set = set()
    out = []
    for i, r in enumerate(rows):
        if not r.size:
            continue
        low = np.array([(mix(r.astype(np.uint64) * f)).min() for f in factor])
        keys = [(k, low[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes()) for k in range(BANDS)]
        if seen.isdisjoint(keys):
            out.append(i)
        seen.update(keys)
    return out


def chain(rows: list[np.ndarray], labels: np.ndarray, categories: list[str], folds: np.ndarray) -> Model:
    """Train on rows of buckets; labels is rows x categories."""
    k = len(categories)
    once = apart(rows)
    rows, labels, folds = [rows[i] for i in once], labels[once], folds[once]
    if not rows:
        return Model(categories, np.zeros(0, np.int32), np.zeros((0, k)), np.zeros((k, k)), np.full(k, -30.0))
    every = np.concatenate(rows)
    found, count = np.unique(every, return_counts=True)
    place, row = np.searchsorted(found, every), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    telling = np.zeros((found.size, k), bool)
    for c in range(k):
        p = np.clip(labels[:, c].mean(), 1e-9, 1 - 1e-9)
        held = np.bincount(place, labels[row, c], found.size)
        telling[:, c] = (count >= MIN_DOCUMENTS) & (np.abs(held - count * p) >= Z_LEAST * np.sqrt(count * p * (1 - p)))
    kept = telling.any(1)
    weights, links, bias, extra = np.zeros((found.size, k)), np.zeros((k, k)), np.zeros(k), np.zeros((len(rows), 0))
    for c in range(k):
        y, own = labels[:, c].astype(float), np.flatnonzero(telling[:, c])
        hit = telling[place, c]
        x = Sparse(np.searchsorted(own, place[hit]), row[hit], len(rows), own.size)
        weights[own, c], links[c, :c], bias[c] = _logistic(x, extra, y, np.ones(len(rows)))
        if c + 1 < k:
            unseen = np.zeros(len(rows))
            for f in range(FOLDS):
                w, v, b = _logistic(x, extra, y, (folds != f).astype(float))
                out = folds == f
                unseen[out] = (x.dot(w) + extra @ v + b)[out]
            extra = np.column_stack([extra, _squash(unseen)])
    return Model(categories, found[kept].astype(np.int32), weights[kept], links, bias)


def _squash(logit: np.ndarray) -> np.ndarray:
    """The probability that later models get."""
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def probabilities(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    k, n = len(model.categories), len(rows)
    p = np.zeros((n, k))
    for i, r in enumerate(rows):
        at = np.searchsorted(model.buckets, r)
        hit = at[(at < model.buckets.size)]
        hit = hit[model.buckets[hit] == r[at < model.buckets.size]]
        p[i] = model.weights[hit].sum(0)
    for c in range(k):
        p[:, c] = _squash(p[:, c] + p[:, :c] @ model.links[c, :c] + model.bias[c])
    return p


def _features(it):
    for b, data, bounds in batches(it):
        rows = word_buckets(data, bounds)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("wanted"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "wanted", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> Model:
    """Learn the chain; categories maps each category, in order, to an SQL condition over labels."""
    wanted = F.array(*[F.expr(f"cast(({sql}) as double)").alias(c) for c, sql in categories.items()])
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), wanted.alias("wanted")).where("doc_id is not null and not exists(wanted, x -> x is null)")
    total = named.count()
    share = int(min(1.0, sample / max(1, total)) * (1 << 30))
    # The hash takes about `sample` rows, whatever their number, so the broadcast is bounded.
    drawn = named.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share).groupBy("doc_id").agg(F.max("wanted").alias("wanted"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    # One text for each label, so that a doc_id with very many rows doesn't swell the sample.
    rows = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("wanted").alias("wanted"))
    got = rows.mapInArrow(_features, "doc_id long, wanted array<double>, buckets binary").toArrow()
    order = np.argsort(ids_of(got["doc_id"]), kind="stable")
    features = [np.frombuffer(b, np.int32) for b in got["buckets"].to_pylist()]
    values = got["wanted"].to_pylist()
    y = np.array([values[i] for i in order.tolist()]).reshape(len(order), len(categories))
    folds = (ids_of(got["doc_id"])[order] * 2654435761 >> 16) % FOLDS
    return chain([features[i] for i in order.tolist()], y, list(categories), folds)


def _predict(shared):
    def run(it):
        model = shared.value
        for b, data, bounds in batches(it):
            p = probabilities(model, word_buckets(data, bounds))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "p"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of each category, as columns p_<category>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(shared), "doc_id long, p array<double>")
    return rows.select("doc_id", *[F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(model.categories)])
