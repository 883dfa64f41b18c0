"""What the text operators share: word arrays, hashes, buckets and tables that cut lineage.

A word is `[^\\x20\\x09-\\x0D]+` of the UTF-8 text. Words and windows of words
are handled as numpy arrays over the bytes of many documents at once. A word's
hash takes in eight bytes at a time, each step a bijection on 64 bits (words of
more than LONG_WORD bytes go through BLAKE2b); a window's hash takes in its
words' hashes in the same way.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of the array code takes on at a time.
CHUNK_BYTES = 1 << 20
#: Rows without a doc_id sort behind all others.
NO_ID = np.iinfo(np.int64).max

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_STEP, _WINDOW = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables that cut lineage."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            return "/tmp/checkpoints/marginalia"  # one machine, so it is shared
        at = found.get()
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave and that nothing will read again."""
    for t in tables:
        drop_path(t.sparkSession, t.stored_at)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, df: DataFrame) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in itertools.chain([name], (f"{name}_{k}" for k in itertools.count())) if x.lower() not in taken)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which each input bit moves every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """The words of some documents as arrays.

    data: the bytes; bounds: n + 1 offsets of the documents in data;
    start, end: of each word in data; doc: the document of each word;
    first: n + 1 offsets of the documents' words.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SEPARATOR):
        n = data.size
        word = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        edge[0] = edge[n] = True
        away = np.ones(n + 1, bool)
        away[1:] = ~word
        self.start = np.flatnonzero(word & (away[:-1] | edge[:-1]))
        away[:-1] = ~word
        away[-1] = True
        self.end = np.flatnonzero(word & (away[1:] | edge[1:])) + 1
        self.data, self.bounds = data, bounds
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(bounds.size - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word, of a family by seed."""
        size = self.end - self.start
        # The eight bytes from each place on as a number.
        near = np.ndarray(self.data.size + 1, "<u8", np.append(self.data, np.zeros(9, np.uint8)).tobytes(), 0, (1,))
        h = mix(size.astype(np.uint64) * np.uint64(_STEP) + np.uint64(seed * _WINDOW % (1 << 64)))
        own, at, left = slice(None), self.start, size
        while at.size:
            v = near[at]
            short = left < 8
            v[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[own] = mix((h[own] ^ v) * np.uint64(_STEP))
            more = (left > 8) & (size[own] <= LONG_WORD)
            own = np.arange(size.size)[own][more]
            at, left = at[more] + 8, left[more] - 8
        long = np.flatnonzero(size > LONG_WORD)
        for k, i, j in zip(long.tolist(), self.start[long].tolist(), self.end[long].tolist()):
            h[k] = int.from_bytes(hashlib.blake2b(self.data[i:j].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        return h

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each window of k words that lies in one document."""
        n = hashes.size - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h ^= hashes[j : j + n]
            h *= np.uint64(_WINDOW)
            h ^= h >> np.uint64(32)
        return mix(h[at]), at


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def pieces(bounds: np.ndarray, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes, and of so many rows at most; a longer document stands alone."""
    n, at = bounds.size - 1, 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n, at + (rows or n))
        yield at, to
        at = to


def batches(it: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with their text's bytes and offsets."""
    for b in it:
        data, bounds = text_buffers(b.column("text"))
        for i, j in pieces(bounds, limit, rows):
            yield b.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def give_back() -> None:
    """Hand what this process has freed to the system, instead of keeping it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives back what it has freed, after each batch it makes and at its end.

    Spark keeps workers for later tasks, beside a JVM that has grown to its
    whole heap; what a worker holds then counts as the executor's memory.
    """

    @functools.wraps(run)
    def own(it):
        for out in run(it):
            yield out
            del out
            give_back()
        give_back()

    return own


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and a bucket by a hash of both, so that rows without an id or with one in common are dealt out too."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        bucket_of(buckets).alias("bucket"),
    )


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(buckets)).cast("int")


def crc_of_ids(ids: np.ndarray) -> np.ndarray:
    """crc32 of each id's decimal text; a missing id's text is empty."""
    import zlib

    return np.array([zlib.crc32(b"" if i == NO_ID else b"%d" % i) for i in ids.tolist()], np.int64)


class WordTable:
    """What some function gives for words, remembered by the words' hashes in arrays.

    encode maps a list of words (bytes) to tuples of ints. An entry takes some
    30 bytes; at `limit` entries the table starts anew. Words of more than
    LONG bytes are given to encode each time.
    """

    LONG = 64

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values' pool, and for each word where its values start there and how many there are."""
        if not words.start.size:
            return self.pool, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.keys.size > self.limit:
            self.clear()
        h = words.hashes()
        long = words.end - words.start > self.LONG
        if long.any():
            h[long] = mix(np.flatnonzero(long).astype(np.uint64) ^ np.uint64(1 << 63))
        order = np.argsort(h)
        s = h[order]
        new = np.append(True, s[1:] != s[:-1])
        own, first = s[new], order[new]
        which = np.empty(h.size, np.int64)
        which[order] = np.cumsum(new) - 1
        place = np.searchsorted(self.keys, own)
        known = np.zeros(own.size, bool)
        inside = place < self.keys.size
        known[inside] = self.keys[place[inside]] == own[inside]
        known &= ~long[first]
        miss = np.flatnonzero(~known)
        raw = words.data.tobytes()
        values = self.encode([raw[i:j] for i, j in zip(words.start[first[miss]].tolist(), words.end[first[miss]].tolist())])
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        fresh = np.fromiter(itertools.chain.from_iterable(values), np.int32, int(sizes.sum()))
        starts = self.pool.size + np.cumsum(sizes) - sizes
        pool = np.concatenate([self.pool, fresh])
        at, count = np.empty(own.size, np.int64), np.empty(own.size, np.int64)
        at[known], count[known] = self.at[place[known]], self.count[place[known]]
        at[miss], count[miss] = starts, sizes
        keep = ~long[first[miss]]
        where = place[miss][keep]
        self.keys = np.insert(self.keys, where, own[miss][keep])
        self.at, self.count = np.insert(self.at, where, starts[keep]), np.insert(self.count, where, sizes[keep])
        self.pool = pool
        return pool, at[which], count[which]


def gathered(pool: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[at : at + count] of all words in a row, and the offsets of the words in it."""
    total = np.concatenate([[0], np.cumsum(count)])
    return pool[np.repeat(at - total[:-1], count) + np.arange(total[-1])], total
