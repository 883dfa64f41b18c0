"""Exact dedup by a cuckoo-filter index of live digests.

`dedup` hashes every normalised text (A-Z lowered) and keeps one row of each
group of equal texts, the one with the largest doc_id. The index is sharded
by digest: each map task runs a `CuckooIndex` over its own rows, so that a
group of any size sends one row a task to its shard, where the rows arrive in
the order of their digests and a second index merges them, RUN_KEYS live
digests at a time. The result is joined back by digest, a join whose hot keys
Spark may split. Digests are computed once and stored; texts go nowhere.

Cases: null text counts as empty; an empty table gives an empty result; rows
that share a doc_id and a text are copies like any other (group_size counts
rows); a null doc_id is the smallest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import ids_of, shuffle_partitions, stored, text_buffers, thrifty, unused

SLOTS = 4
MAX_KICKS = 500
#: A map task hands its index on and starts a new one at so many live keys.
MAP_KEYS = RUN_KEYS = 200_000
#: Stands for a null doc_id, below all others.
LOW = -(1 << 63)


class CuckooIndex:
    """A cuckoo filter whose slots hold, beside the fingerprints, the keys and their values.

    A bucket has up to SLOTS entries: fingerprints of 16 bits, whole digests
    (the bucketed content) and values. A lookup compares fingerprints in two
    buckets, and a digest only where one matches, so there are no false
    positives. When an insertion finds no place in MAX_KICKS moves, the table
    doubles and is filled again from the keys in its buckets.
    """

    def __init__(self, buckets: int = 1 << 10):
        self.resizes = self.live = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.slots: list[list[tuple[bytes, list]]] = [[] for _ in range(buckets)]

    def _place(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two buckets; each bucket follows from the other and the fingerprint."""
        mark = int.from_bytes(key[:2], "little") | 1
        one = int.from_bytes(key[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> tuple[int, int] | None:
        mark, one, two = self._place(key)
        for b in (one, two):
            if mark in self.prints[b]:
                for s, p in enumerate(self.prints[b]):
                    if p == mark and self.slots[b][s][0] == key:
                        return b, s
        return None

    def find(self, key: bytes) -> list | None:
        at = self._slot(key)
        return None if at is None else self.slots[at[0]][at[1]][1]

    def insert(self, key: bytes, value: list) -> None:
        """Add a key that the index doesn't have."""
        self.live += 1
        homeless = self._insert((key, value))
        if homeless is not None:
            self._resize(homeless)

    def _insert(self, entry: tuple[bytes, list]) -> tuple[bytes, list] | None:
        """The entry that is left without a place, if one is."""
        mark, one, two = self._place(entry[0])
        for b in (one, two):
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.slots[b].append(entry)
                return None
        b = two
        for kick in range(MAX_KICKS):
            s = (kick + mark) % SLOTS
            self.prints[b][s], mark = mark, self.prints[b][s]
            self.slots[b][s], entry = entry, self.slots[b][s]
            b = self._other(b, mark)
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.slots[b].append(entry)
                return None
        return entry

    def _resize(self, homeless: tuple[bytes, list]) -> None:
        entries, size = [homeless, *self.entries()], self.mask + 1
        while True:
            size *= 2
            self.resizes += 1
            self._clear(size)
            if all(self._insert(e) is None for e in entries):
                return

    def delete(self, key: bytes) -> bool:
        at = self._slot(key)
        if at is None:
            return False
        b, s = at
        del self.prints[b][s], self.slots[b][s]
        self.live -= 1
        return True

    def entries(self) -> Iterator[tuple[bytes, list]]:
        return itertools.chain.from_iterable(self.slots)

    def __len__(self) -> int:
        return self.live

    def add(self, key: bytes, keep: int, rows: int) -> None:
        """Rows of this digest, of which that with the largest id is live: it takes the place of the one before."""
        held = self.find(key)
        if held is not None:
            if keep <= held[0]:
                held[1] += rows
                return
            rows += held[1]
            self.delete(key)
        self.insert(key, [keep, rows])


def _index_batch(index: CuckooIndex) -> pa.RecordBatch:
    entries = list(index.entries())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in entries], pa.binary()),
            pa.array([v[0] for _, v in entries], pa.int64()),
            pa.array([v[1] for _, v in entries], pa.int64()),
        ],
        names=["digest", "keep_id", "group_size"],
    )


INDEX_SCHEMA = "digest binary, keep_id long, group_size long"


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in it:
        data, bounds = text_buffers(b.column("text"))
        raw, at = memoryview(data), bounds.tolist()
        yield b, [hashlib.sha256(bytes(raw[i:j]).lower()).digest() for i, j in zip(at, at[1:])]


@thrifty
def _map_index(it):
    index = CuckooIndex()
    for b in it:
        for i, key in zip(ids_of(b.column("doc_id").fill_null(LOW)).tolist(), b.column("digest").to_pylist()):
            index.add(key, i, 1)
        if len(index) >= MAP_KEYS:
            yield _index_batch(index)
            index = CuckooIndex()
    yield _index_batch(index)


@thrifty
def _merge_index(it):
    """Rows come in the order of their digests, so a digest that has been passed is done with."""
    index, last = CuckooIndex(), None
    for b in it:
        for key, keep, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if key != last and len(index) >= RUN_KEYS:
                yield _index_batch(index)
                index = CuckooIndex()
            index.add(key, keep, rows)
            last = key
    yield _index_batch(index)


@thrifty
def _map_digests(it):
    for b, keys in _digests(it):
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digest of every row, as a stored table."""
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_map_digests, "doc_id long, digest binary"), "digests")


def build_index(digested: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): one row for each live digest, as a stored table."""
    partial = digested.mapInArrow(_map_index, INDEX_SCHEMA)
    sharded = partial.repartition(shuffle_partitions(digested.sparkSession), "digest").sortWithinPartitions("digest")
    return stored(sharded.mapInArrow(_merge_index, INDEX_SCHEMA), "index")


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digested = digests(docs)
    index = build_index(digested).withColumn("keep_id", F.expr(f"nullif(keep_id, {LOW + 1} - 1)"))
    return digested.join(index, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _with_digest(name: str):
    def run(it):
        for b, keys in _digests(it):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, name])

    return run


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs; of rows with equal doc_id and equal text one."""
    mark = unused("marginalia_digest", docs)
    verdict = dedup(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
    marked = docs.mapInArrow(thrifty(_with_digest(mark)), T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())]))
    a, b = marked.alias("a"), verdict.withColumn("digest", F.unhex("text_sha256")).alias("b")
    same = F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{mark}") == F.col("b.digest"))
    once = a.join(b.where("n = 1"), same, "left_semi")
    repeated = a.join(b.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", mark])
    return once.union(repeated).drop(mark)
