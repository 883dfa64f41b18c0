"""Language-model scores by context-tree weighting over bytes.

A text is its lowered bytes and an end byte; what stands before a text are
end bytes. Each byte is eight binary decisions, and each decision has a
context tree of its own over the last DEPTH bytes. `fit` counts zeros and
ones of all decisions in all contexts over all training documents; in every
node the Krichevsky-Trofimov block probability of its counts and, from the
leaves up, the weighted probability

    P_w(s) = 1/2 KT(s) + 1/2 prod over children P_w(cs)

give the weight KT(s) / 2 P_w(s) of the node's own estimate against those of
longer contexts. The probability of a bit is this mixture over all depths; a
context that training has not seen hands its share to the one a byte shorter.

Counting passes over every training text. Map tasks send the distinct strings
of DEPTH + 1 bytes with their counts to shards by the two bytes nearest to the
last; all longer contexts of these two are in the same shard, which so builds
its part of the trees exactly, whatever the input. Words are counted on the way
in the same shards by their hashes, for the base of `score`: add-one smoothing.

Scoring goes to the counts. Each bucket of documents asks the shards for its
distinct strings and words, so one in every document is one entry a bucket. A
shard builds its trees again and answers with the strings' probabilities under
all of its nodes; no table of nodes is sent anywhere, and no node is left out.
Only the nodes of one byte of context and of none, whose sums come from all
shards, are broadcast.

Cases: null text is empty and is one end token; an empty table gives no rows;
without training documents all bits have probability 1/2 and no word is
known; rows that share a doc_id share train and held-out side; a null doc_id
counts by the rule given; very long texts are scored whole; other columns are
ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER, Words, batches, ids_of, ids_out, mix, pieces, shuffle_partitions, stored, text_buffers

DEPTH = 5
#: Count from which on a node takes part: all that training has met.
LEAST = 1
END = 0xFF
#: Log of the number of shards at most; below it they are about as many as shuffle partitions.
SHARD_BITS = 9
#: Bytes of rows that a map task deals to buckets at a time.
DEALT = 32 << 20
#: Bytes of text that are scored at a time.
PIECE = 2 << 20
#: Distinct byte strings that a map task holds before it joins equal ones.
HELD = 4 << 20

#: Strings in ascending order and their counts, words' hashes and theirs, the sum of the latter and how many words there are.
COUNTS = "shard int, codes binary, counts binary, words binary, times binary, total long, size long"
NEAR = "near binary, zeros1 binary, ones1 binary, below1 binary"
DOCS = "bucket int, ids binary, train binary, sizes binary, texts binary"
ASK = "shard int, bucket int, codes binary, words binary"
ANSWER = "shard int, bucket int, values binary, times binary"
RESULT = "doc_id long, train boolean, n_tokens long, n_known long, known_log double, score double, n_bytes long"


def strings(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last DEPTH + 1 bytes up to each byte and each end of the texts, as one number, and the first of each text."""
    n = bounds.size - 1
    size = np.diff(bounds)
    first = bounds[:-1] + np.arange(n) * (DEPTH + 1)
    line = np.full(data.size + n * (DEPTH + 1), END, np.uint64)
    at = np.arange(data.size) + np.repeat(first + DEPTH - bounds[:-1], size)
    line[at] = LOWER[data]
    code = np.zeros(line.size - DEPTH, np.uint64)
    for j in range(DEPTH + 1):
        code = (code << np.uint64(8)) | line[j : line.size - DEPTH + j]
    # Position p of the line ends the string p - DEPTH; each text has size + 1 of them.
    begin = bounds[:-1] + np.arange(n)
    own = np.arange(data.size + n) + np.repeat(first - begin, size + 1)
    return code[own], begin


def key_of(depth: int, code: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The name of a node of the last byte's tree in the context of the depth bytes before it."""
    context = (code >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return np.uint64(depth << 60) | context << np.uint64(8) | node


def _bits(code: np.ndarray):
    """The eight decisions of the last byte: node and bit."""
    byte = code & np.uint64(0xFF)
    for k in range(8):
        yield (np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k)), (byte >> np.uint64(7 - k)) & np.uint64(1)


def _joined(code: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order and the sums of their counts."""
    if count is None:
        s = np.sort(code)
        new = np.append(True, s[1:] != s[:-1]) if s.size else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return s[at], np.diff(np.append(at, s.size))
    order = np.argsort(code, kind="stable")
    s = code[order]
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1]) if s.size else np.zeros(0, bool))
    return s[at], np.add.reduceat(count[order], at) if at.size else count[:0]


def _sent(x: np.ndarray) -> bytes:
    """The size of an array and its bytes, those of the same place in a number side by side and compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _got(blob: bytes, kind: str) -> np.ndarray:
    size, wide = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(kind).ravel()


def _sent_codes(code: np.ndarray) -> bytes:
    """Codes ascend, so their differences have few bytes."""
    return _sent(np.diff(code, prepend=np.uint64(0)))


def _got_codes(blob: bytes) -> np.ndarray:
    return np.cumsum(_got(blob, "<u8"), dtype=np.uint64)


def shard_of(code: np.ndarray, bits: int) -> np.ndarray:
    """By the two bytes nearest to the last."""
    return (mix((code >> np.uint64(8)) & np.uint64(0xFFFF)) >> np.uint64(64 - bits)).astype(np.int32)


def _by_key(key: np.ndarray):
    """The order of the keys, and each key with its range in it."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    b = np.flatnonzero(np.append(True, s[1:] != s[:-1]))[: s.size].tolist()
    return order, [(int(s[i]), i, j) for i, j in zip(b, [*b[1:], s.size])]


def _by_shard(code: np.ndarray, words: np.ndarray, bits: int):
    """The order of the strings by shards, and for each shard the ranges of its strings and its words; words' hashes ascend and have their shard in front."""
    order, ranges = _by_key(shard_of(code, bits))
    cut = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
    at = {k: (i, j) for k, i, j in ranges}
    return order, [(k, *at.get(k, (0, 0)), cut[k], cut[k + 1]) for k in range(1 << bits) if k in at or cut[k] < cut[k + 1]]


class _Counter:
    """Distinct values with their counts, in ascending order."""

    def __init__(self):
        self.code, self.count, self.more, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, code: np.ndarray, count: np.ndarray | None = None) -> None:
        self.more.append(_joined(code, count))
        self.held += self.more[-1][0].size
        if self.held > HELD:
            self.join()

    def join(self) -> tuple[np.ndarray, np.ndarray]:
        self.code, self.count = _joined(np.concatenate([self.code, *(c for c, _ in self.more)]), np.concatenate([self.count, *(n for _, n in self.more)]))
        self.more, self.held = [], 0
        return self.code, self.count


def _count(shard_bits: int):
    def run(it):
        codes, prints = _Counter(), _Counter()
        for _, data, bounds in batches(it):
            codes.add(strings(data, bounds)[0])
            prints.add(Words(LOWER[data], bounds).hashes())
        (code, count), (words, times) = codes.join(), prints.join()
        order, ranges = _by_shard(code, words, shard_bits)
        code, count = code[order], count[order]
        for shard, i, j, v, w in ranges:
            yield pa.RecordBatch.from_pydict(_counts_row(shard, code[i:j], count[i:j], words[v:w], times[v:w]), _COUNTS)

    return run


_COUNTS = pa.schema([("shard", pa.int32()), *[(x, pa.binary()) for x in ("codes", "counts", "words", "times")], ("total", pa.int64()), ("size", pa.int64())])


def _counts_row(shard: int, code: np.ndarray, count: np.ndarray, words: np.ndarray, times: np.ndarray) -> dict[str, list]:
    blobs = {"codes": _sent_codes(code), "counts": _sent(count.astype("<u8")), "words": _sent_codes(words), "times": _sent(times.astype("<u8"))}
    return {"shard": [shard], **{k: [x] for k, x in blobs.items()}, "total": [int(times.sum())], "size": [words.size]}


def _sums(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys in ascending order, sums of the values for each, and the order used."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if s.size else np.zeros(0, np.int64)
    return s[cut], [np.add.reduceat(v[order], cut) if cut.size else v[:0] for v in values], order


def _merge(group: pa.Table) -> pa.Table:
    """The distinct strings and words of a shard."""
    merged = []
    for codes, counts in (("codes", "counts"), ("words", "times")):
        counter = _Counter()
        for x, n in zip(group.column(codes).to_pylist(), group.column(counts).to_pylist()):
            counter.add(_got_codes(x), _got(n, "<u8").astype(np.int64))
        merged += counter.join()
    return pa.Table.from_pydict(_counts_row(group.column("shard")[0].as_py(), *merged), _COUNTS)


def levels(code: np.ndarray, count: np.ndarray):
    """Depth, keys, zeros, ones, weights of their own estimates and weighted probabilities of the nodes of all contexts of two bytes and more in a shard, the longest first."""
    count = count.astype(np.float64)
    # Of the depth before: the nodes' keys without their farthest byte, and their weighted probabilities.
    up = total = None
    for depth in range(DEPTH, 1, -1):
        nodes, bits = zip(*_bits(code))
        key, (n, n1), _ = _sums(np.concatenate([key_of(depth, code, u) for u in nodes]), [np.tile(count, 8), np.concatenate([count * b for b in bits])])
        kt = block(n - n1, n1)
        if up is None:
            total, own = kt, np.ones(key.size)
        else:
            children = np.bincount(np.searchsorted(key, up), total, key.size)
            total = np.logaddexp(kt, children) - np.log(2)
            own = np.exp(np.minimum(0.0, kt - np.log(2) - total))
        yield depth, key, n - n1, n1, own, total
        up = key & np.uint64((1 << 8 * depth) - 1) | np.uint64((depth - 1) << 60)
        if depth > 2:
            # Strings with the same bytes up to the next depth are one from here on.
            code, (count,), _ = _sums(code & np.uint64((1 << 8 * depth) - 1), [count])


def _near(it):
    """Of each shard, the sums over its nodes of two bytes of context for those of one."""
    for b in it:
        for codes, counts in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist()):
            code = _got_codes(codes)
            if not code.size:
                continue
            for _, key, zeros, ones, _, total in levels(code, _got(counts, "<u8")):
                pass
            near, sums, _ = _sums(key & np.uint64(0xFFFF), [zeros, ones, total])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (near, *sums)], names=["near", "zeros1", "ones1", "below1"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after eight steps up."""
    shift = x.copy()
    for k in range(1, 8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def shallow(near: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[tuple]:
    """Depth, keys, ones and weights of the nodes of one byte of context and of none, from the sums for the former."""
    key, (n0, n1, children), _ = _sums(near, [zeros, ones, below])
    out = []
    for depth in (1, 0):
        kt = block(n0, n1)
        total = np.logaddexp(kt, children) - np.log(2)
        out.append((depth, key | np.uint64(depth << 60), (n1 + 0.5) / (n0 + n1 + 1), np.exp(np.minimum(0.0, kt - np.log(2) - total))))
        key, (n0, n1, children), _ = _sums(key & np.uint64(0xFF), [n0, n1, total])
    return out


class Model:
    """The counts of all strings and words in shards, and the nodes of one byte of context and of none."""

    def __init__(self, counts: DataFrame, top: list[tuple], shard_bits: int):
        self.counts, self.top, self.shard_bits = counts, top, shard_bits
        self._shards: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A shard's codes and counts, for looking up a few strings."""
        if k not in self._shards:
            row = self.counts.where(F.col("shard") == k).first()
            self._shards[k] = (_got_codes(row["codes"]), _got(row["counts"], "<u8")) if row else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        return self._shards[k]


def fit(docs: DataFrame) -> Model:
    """The model of all texts of docs."""
    shard_bits = max(2, min(SHARD_BITS, (shuffle_partitions(docs.sparkSession) - 1).bit_length()))
    partial = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(shard_bits), COUNTS)
    counts = stored(partial.groupBy("shard").applyInArrow(_merge, COUNTS), "counts")
    # For each shard its sums for depth 1.
    near = counts.select("codes", "counts").mapInArrow(_near, NEAR).toArrow()
    sums = [_bytes_of(near.column(c), kind) for c, kind in (("near", "<u8"), ("zeros1", "<f8"), ("ones1", "<f8"), ("below1", "<f8"))]
    return Model(counts, shallow(*sums), shard_bits)


def _bytes_of(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The blobs of a column one after the other."""
    parts = [text_buffers(c)[0].view(kind) for c in column.chunks]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def probabilities(code: np.ndarray, count: np.ndarray, top: list[tuple], asked: np.ndarray) -> np.ndarray:
    """log10 probabilities of the last bytes of strings of a shard, which are distinct and ascend, from the shard's counts and the top nodes."""
    decisions = []
    for k, (node, bit) in enumerate(_bits(asked)):
        # Strings in a row with the same bytes and the same bits so far share this decision.
        same = asked >> np.uint64(8 - k)
        new = np.append(True, same[1:] != same[:-1])[: asked.size]
        decisions.append((asked[new], node[new], np.full(int(new.sum()), 0.5), np.zeros(int(new.sum()), bool), np.cumsum(new) - 1, bit))
    deep = ((depth, key, (n1 + 0.5) / (n0 + n1 + 1), own) for depth, key, n0, n1, own, _ in levels(code, count)) if code.size else ()
    for depth, keys, ones, owns in itertools.chain(deep, top):
        if not keys.size:
            continue
        for own_code, node, p, known, _, _ in decisions:
            want = key_of(depth, own_code, node)
            at = np.minimum(np.searchsorted(keys, want), keys.size - 1)
            found = keys[at] == want
            # The longest context that is there stands alone; each shorter one takes its weight of the mixture.
            own = np.where(known, owns[at], 1.0) * found
            p += own * (ones[at] - p)
            known |= found
    out = np.zeros(asked.size)
    for _, _, p, _, which, bit in decisions:
        one = p[which]
        out += np.log10(np.where(bit > 0, one, 1 - one))
    return out


def log10_probabilities(model: Model, code: np.ndarray) -> np.ndarray:
    """Of the last byte of each of a few strings after the bytes before it."""
    out, (order, ranges) = np.zeros(code.size), _by_key(shard_of(code, model.shard_bits))
    for k, i, j in ranges:
        asked, back = np.unique(code[order[i:j]], return_inverse=True)
        out[order[i:j]] = probabilities(*model.shard(k), model.top, asked)[back]
    return out


def _deal(it):
    """The rows of each bucket that a map task has at a time, as one row."""

    def cut(held):
        rows = pa.Table.from_batches(held)
        order, ranges = _by_key(rows.column("bucket").to_numpy())
        rows = rows.take(pa.array(order))
        ids, train = ids_of(rows.column("doc_id")), rows.column("train").to_numpy().astype(np.uint8)
        data, bounds = text_buffers(rows.column("text"))
        cells = [(k, ids[i:j].tobytes(), train[i:j].tobytes(), np.diff(bounds[i : j + 1]).tobytes(), _sent(data[bounds[i] : bounds[j]])) for k, i, j in ranges]
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), kinds)], names=["bucket", "ids", "train", "sizes", "texts"])

    held, size = [], 0
    for b in it:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size > DEALT:
            yield cut(held)
            held, size = [], 0
    if held:
        yield cut(held)


def _docs(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sides, bytes and bounds of the documents of a bucket."""
    ids, train, sizes = (np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in (("ids", np.int64), ("train", bool), ("sizes", np.int64)))
    return ids, train, np.concatenate([_got(x, "u1") for x in group.column("texts").to_pylist()]), np.concatenate([[0], np.cumsum(sizes)])


def _distinct_strings(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    counter = _Counter()
    for i, j in pieces(bounds, PIECE):
        counter.add(strings(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[0])
    return counter.join()[0]


def _ask(shard_bits: int):
    def run(group: pa.Table) -> pa.Table:
        _, _, data, bounds = _docs(group)
        code, words = _distinct_strings(data, bounds), np.unique(Words(LOWER[data], bounds).hashes())
        order, ranges = _by_shard(code, words, shard_bits)
        code, bucket = code[order], group.column("bucket")[0].as_py()
        rows = [(k, bucket, _sent_codes(code[i:j]), _sent_codes(words[v:w])) for k, i, j, v, w in ranges]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["shard", "bucket", "codes", "words"])

    return run


def _answer(top):
    """The probability of each string asked for, and the count of each word, in the order asked."""

    def run(asks: pa.Table, counts: pa.Table) -> pa.Table:
        values: list[bytes] = []
        times: list[bytes] = []
        if asks.num_rows:
            code = count = words = of_words = np.zeros(0, np.uint64)
            if counts.num_rows:
                blobs = {c: counts.column(c)[0].as_py() for c in ("codes", "counts", "words", "times")}
                code, count, words, of_words = _got_codes(blobs["codes"]), _got(blobs["counts"], "<u8"), _got_codes(blobs["words"]), _got(blobs["times"], "<u8")
            every, asked_codes = _Counter(), asks.column("codes").to_pylist()
            for x in asked_codes:
                every.add(_got_codes(x))
            asked = every.join()[0]
            value = probabilities(code, count, top.value, asked).astype("<f4")
            values = [_sent(value[np.searchsorted(asked, _got_codes(x))]) for x in asked_codes]
            words, of_words = np.append(words, np.uint64(2**64 - 1)), np.append(of_words, np.uint64(0))
            for x in map(_got_codes, asks.column("words").to_pylist()):
                at = np.searchsorted(words, x)
                times.append(_sent(np.where(words[at] == x, of_words[at], np.uint64(0))))
        blobs = (pa.array(x, pa.binary()) for x in (values, times))
        return pa.table([asks.column("shard"), asks.column("bucket"), *blobs], names=["shard", "bucket", "values", "times"])

    return run


def text_scores(asked: np.ndarray, values: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each whole text, from those of its distinct strings."""
    code, begin = strings(data, bounds)
    order = np.argsort(code)
    s = code[order]
    new = np.append(True, s[1:] != s[:-1])
    value = np.empty(code.size)
    value[order] = values[np.searchsorted(asked, s[new])][np.cumsum(new) - 1]
    return np.add.reduceat(value, begin)


def _score(shard_bits: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        names = ["doc_id", "train", "n_tokens", "n_known", "known_log", "score", "n_bytes"]
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids, train, data, bounds = _docs(docs)
        in_order = np.argsort(answers.column("shard").to_numpy()).tolist()
        values, times = answers.column("values").to_pylist(), answers.column("times").to_pylist()

        asked = _distinct_strings(data, bounds)
        value = np.empty(asked.size)
        value[np.argsort(shard_of(asked, shard_bits), kind="stable")] = np.concatenate([_got(values[i], "<f4") for i in in_order])
        scores = np.concatenate([text_scores(asked, value, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in pieces(bounds, PIECE)])

        words, n = Words(LOWER[data], bounds), ids.size
        count = np.concatenate([_got(times[i], "<u8") for i in in_order])[np.unique(words.hashes(), return_inverse=True)[1]]
        known = np.bincount(words.doc, count > 0, n).astype(np.int64)
        logs = np.bincount(words.doc, np.log10(count + 1.0), n)
        out = (ids_out(ids), train, np.diff(words.first) + 1, known, logs, scores, np.diff(bounds))
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    return run


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Scores of every row by what is learnt from the rows where train holds.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    model = fit(rows.where("train"))
    ends = rows.where("train").count()
    total = model.counts.agg(F.sum("total"), F.sum("size")).first()
    tokens, words = (total[0] or 0) + ends, (total[1] or 0) + (ends > 0)

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(4 * shuffle_partitions(spark))).cast("int")
    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train", place.alias("bucket")).mapInArrow(_deal, DOCS)
    asks = dealt.groupBy("bucket").applyInArrow(_ask(model.shard_bits), ASK)
    counts = model.counts.select("shard", "codes", "counts", "words", "times")
    answers = asks.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(_answer(spark.sparkContext.broadcast(model.top)), ANSWER)
    scored = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score(model.shard_bits), RESULT)
    base = F.col("known_log") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + 1.0 * (words + 1))))
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10.0))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
