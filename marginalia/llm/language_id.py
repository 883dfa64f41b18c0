"""Language identification by error-correcting output codes.

Every language has a codeword; for each of its bits a binary logistic model
over hashed character n-grams predicts the bit of a text. Decoding takes the
language whose codeword has the least sum of logistic losses, each bit
weighted by how well its model tells that language in training; a small lead
over the second codeword flags the text as ambiguous.

`fit` learns from a bounded sample: about SAMPLE_PER_LANGUAGE distinct texts
of each language at most, taken by a hash of doc_id and text, each as one
vector of BUCKETS numbers made of the whole text on the executors. `predict`
passes over whole texts; the model (a few hundred KB) goes to the tasks.

Cases: null or empty text, and text without a letter, is `und` with score 0;
an empty training table, or one without languages, gives a model that answers
`und` to all; one language is learnt as that one with score 1; ties go to the
language that sorts first; doc_ids may be null or repeated (equal rows count
once); very long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER, batches, thrifty, unused

UNDETERMINED = "und"
#: n-grams of 1, 2 and 3 bytes of the lowered text fall into so many buckets.
BUCKETS = 4096
#: The bound on the training sample: distinct texts of each language, about.
SAMPLE_PER_LANGUAGE = 1500
#: Documents in one piece of work, each with BUCKETS numbers of some 30 bytes in all.
PIECE_ROWS = 128
#: Leads (in weighted loss per bit) below this are ambiguous.
AMBIGUOUS_LEAD = 0.1
STEPS = 300
RIDGE = 1e-4


@dataclass
class Model:
    languages: list[str]
    #: languages x bits, -1 or 1
    code: np.ndarray
    #: languages x bits, rows sum to 1
    trust: np.ndarray
    #: BUCKETS x bits
    weights: np.ndarray
    bias: np.ndarray


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A k x bits matrix of -1 and 1.

    Up to five classes: all distinct splits of the classes (exhaustive code);
    beyond: the random dense code of about 10 log2 k bits, of 200 drawn, with
    the largest least distance between two rows.
    """
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(k - 1)] for s in range((1 << (k - 1)) - 1)]
        return np.array(splits, float).T
    rng, bits, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (k, bits))
        near = (bits - (c @ c.T) + 2 * bits * np.eye(k)).min()
        if (np.abs(c.sum(0)) < k).all() and near > far:
            best, far = c, near
    return best


def _grams(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, bucket of each n-gram) over the lowered bytes; a gram may reach into the next text."""
    x = LOWER[data].astype(np.uint32)
    out = [(1, x)]
    if x.size > 1:
        two = x[:-1] * np.uint32(257) + x[1:]
        out.append((2, 256 + (two * np.uint32(2654435761) >> np.uint32(22))))
    if x.size > 2:
        three = (x[:-2] * np.uint32(65599) + x[1:-1]) * np.uint32(65599) + x[2:]
        out.append((3, 1280 + (three * np.uint32(2246822519) >> np.uint32(16)) % np.uint32(BUCKETS - 1280)))
    return out


def _vectors(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Square roots of relative n-gram counts, documents x BUCKETS."""
    n = bounds.size - 1
    out = np.zeros((n, BUCKETS), np.float32)
    for i in range(n):
        part = data[bounds[i] : bounds[i + 1]]
        for size, g in _grams(part):
            out[i] += np.bincount(g, minlength=BUCKETS)[:BUCKETS] / max(1, g.size)
    return np.sqrt(out)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@thrifty
def _features(it):
    for b, data, bounds in batches(it, rows=PIECE_ROWS):
        v = _vectors(data, bounds).astype(np.float16)
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.tobytes() for r in v], pa.binary())], names=["lang", "vector"])


def _vectors_in(column: pa.Array) -> np.ndarray:
    """The vectors of a chunk, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.float16).reshape(-1, BUCKETS)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic model for each column of y (-1 or 1), by accelerated gradient steps."""
    n, d = x.shape
    w, b = np.zeros((d, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    share = np.clip((y > 0).mean(0), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / n
    step = 4.0 / (float((x * x).sum(1).max()) + 1.0) / max(1.0, float(weight.max() * n))
    vw, vb, pw, pb = w, b, w, b
    for t in range(1, STEPS + 1):
        g = -y * weight / (1 + np.exp(np.clip(y * (x @ vw + vb), -30, 30)))
        w, b = vw - step * (x.T @ g + RIDGE * vw), vb - step * g.sum(0)
        m = (t - 1) / (t + 2)
        vw, vb, pw, pb = w + m * (w - pw), b + m * (b - pb), w, b
    return w, b


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from docs' text and non-null lang."""
    named = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1)), np.ones((len(languages), 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    # The hash takes about per_language rows of each language, whatever their number; those with one text are one.
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30))
    drawn = named.where(place < F.element_at(shares, F.col("lang")) * float(1 << 30)).select("lang", "text").dropDuplicates()
    rows = drawn.mapInArrow(_features, "lang string, vector binary").toArrow()
    missing = sorted(set(languages) - set(rows["lang"].to_pylist()))
    if missing:  # a language of a few texts in very many copies: one of them
        one = named.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min("text").alias("text"))
        rows = pa.concat_tables([rows, one.mapInArrow(_features, "lang string, vector binary").toArrow()])
    label = np.searchsorted(np.array(languages), np.array(rows["lang"].to_pylist()))
    # Half floats straight from the Arrow buffers: the sample is on the driver once, and once more as floats.
    x = np.concatenate([_vectors_in(c) for c in rows["vector"].chunks]).astype(np.float32)
    del rows
    code = codewords(len(languages))
    w, b = _logistic(x, code[label].astype(np.float32))
    f = x @ w + b
    hit = (f * code[label] > 0).astype(float)
    trust = np.stack([hit[label == k].mean(0) if (label == k).any() else np.ones(code.shape[1]) for k in range(len(languages))]) + 1e-3
    return Model(languages, code, trust / trust.sum(1, keepdims=True), w, b)


def decode(model: Model, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language, score and lead of each row of bit predictions f."""
    loss = np.stack([(np.logaddexp(0, -f * model.code[k]) * model.trust[k]).sum(1) for k in range(len(model.languages))], 1)
    best = loss.argmin(1)
    near = np.sort(loss, 1)
    lead = near[:, 1] - near[:, 0] if loss.shape[1] > 1 else np.full(len(f), np.inf)
    p = np.exp(-(loss - near[:, :1]) * model.code.shape[1])
    return best, 1 / p.sum(1), lead


def bits(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bit predictions of each whole text."""
    n, length = bounds.size - 1, np.diff(bounds)
    count = np.zeros((n, BUCKETS), np.float32)
    doc = np.repeat(np.arange(n, dtype=np.int64), length)
    for size, g in _grams(data):
        d = doc[: g.size]
        inside = d == doc[size - 1 :]
        total = np.bincount(d[inside] * BUCKETS + g[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
        count += total / np.maximum(1, length - size + 1)[:, None]
    return np.sqrt(count) @ model.weights + model.bias


def _predict(shared, known: bool, out: list[str]):
    def run(it):
        model = shared.value
        for b, data, bounds in batches(it, 1 << 20, PIECE_ROWS):
            n = b.num_rows
            lettered = np.array([t is not None and has_letter(t) for t in b.column("text").to_pylist()], bool)
            pred, score, unsure = [UNDETERMINED] * n, np.zeros(n), ~lettered
            if known and lettered.any():
                best, p, lead = decode(model, bits(model, data, bounds))
                pred = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered.tolist())]
                score = np.where(lettered, np.clip(p, 0.0, 1.0), 0.0)
                unsure = unsure | (lead < AMBIGUOUS_LEAD)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(score), pa.array(unsure)], names=[*b.schema.names, *out])

    return run


OUT = ["marginalia_lang", "marginalia_score", "marginalia_ambiguous"]


def annotate(docs: DataFrame, model: Model, out: list[str] = OUT) -> DataFrame:
    """docs with columns named in out: language, score between 0 and 1, and whether the decision is ambiguous."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, out, kinds)])
    return docs.mapInArrow(thrifty(_predict(shared, bool(model.languages), out)), schema)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that have a language, with the columns of docs; an ambiguous decision is one."""
    out = [unused(name, docs) for name in OUT]
    return annotate(docs, model, out).where(F.col(out[0]) != UNDETERMINED).drop(*out)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select(
        "doc_id", F.col(OUT[0]).alias("lang_pred"), F.col(OUT[1]).alias("score"), F.col(OUT[2]).alias("ambiguous")
    )
