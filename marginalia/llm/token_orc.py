"""Token ids of every document in ORC files, and how to read them back.

`write` encodes texts, deals them out by ranges of doc_id and writes one ORC
file a range: ids as integers (ORC's run-length encoding packs them), a row
index every ROW_INDEX_STRIDE rows and a Bloom filter on doc_id, so that a
reader skips stripes and row groups by metadata and reads stripes in
parallel. `read` gives documents with the position of their first id in the
whole sequence: a file stores positions within itself, and the totals of the
files, a row each, are added when they are read.

Cases: null text is empty (one end id); an empty table gives no rows; rows
that share a doc_id are ordered by their text; null doc_ids come first; very
long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import WordTable, Words, batches, gathered, shared_dir, shuffle_partitions

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_000_000
SCHEMA = "doc_id long, part_start long, n_tokens long, ids array<int>"


class WordEncoder:
    """Ids of texts by way of their words.

    The tokenizer drops white space and its patterns never reach across it, so
    the ids of a text are those of its words, one after the other. A word of
    Latin-1 letters is one token of the pre-tokenizer, and a comma or full stop
    after it another, so it goes to the library's BPE model at once; other
    words take the library's whole way. A table remembers the words' ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # How the pre-tokenizer writes the bytes of two-byte characters.
        self.written = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.stops = {c: tuple(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in ",."}
        self.table = WordTable(self._words, CACHE_WORDS)

    def _word(self, raw: bytes) -> tuple[int, ...] | None:
        w, stop = raw.decode().lower(), ()
        if w[-1] in ",." and len(w) > 1:
            stop, w = self.stops[w[-1]], w[:-1]
        if not w.isalpha() or max(w) > "\xff":
            return None
        if not w.isascii():
            w = w.translate(self.written)
        return (*[t.id for t in self.model.tokenize(w)], *stop)

    def _words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        out = [self._word(w) for w in words]
        slow = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(slow, self.tokenizer.encode_batch([words[k].decode() for k in slow], add_special_tokens=False)):
            out[k] = tuple(e.ids)
        return out

    def flat(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id after it, and how many each has."""
        words = Words(data, bounds)
        pool, at, count = self.table.find(words)
        # The end of a text is one more word, whose id lies at the end of the pool.
        ends = words.first[1:]
        ids, total = gathered(np.append(pool, np.int32(end_id)), np.insert(at, ends, pool.size), np.insert(count, ends, 1))
        return ids, np.diff(total[ends + np.arange(1, ends.size + 1)], prepend=0)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str | None) -> WordEncoder:
    """The worker's encoder; the file is read where the task runs."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode(path: str | None, end_id: int):
    def run(it):
        enc, before = encoder(path), 0
        gc.disable()  # millions of small tuples and no cycles
        for b, data, bounds in batches(it, 1 << 20):
            values, sizes = enc.flat(data, bounds, end_id)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            starts, before = before + offsets[:-1], before + int(offsets[-1])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(sizes), ids], names=["doc_id", "part_start", "n_tokens", "ids"])

    return run


def write(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, parts: int | None = None) -> None:
    """Write docs' ids to ORC files in ascending order of doc_id, a file for each range."""
    parts = parts or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (
        dealt.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("compression", "zstd")
        .orc(out)
    )


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files."""
    # Part numbers in file names ascend with the range of doc_id.
    part = F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)", 1).cast("int").alias("part")
    rows = spark.read.schema(SCHEMA).orc(at)
    totals = rows.select(part, (F.col("part_start") + F.col("n_tokens")).alias("end")).groupBy("part").agg(F.max("end").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    # A row for each file, so its size is bounded by the number of ranges.
    return rows.select("*", part).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, at: str, doc_ids: list[int]) -> DataFrame:
    """The given documents; stripes without them are skipped by range and Bloom filter."""
    return read(spark, at).where(F.col("doc_id").isin(doc_ids))


def _digest(it):
    for b in it:
        ids = b.column("ids")
        values = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")
        at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return rows.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-orc-{uuid.uuid4().hex}"
