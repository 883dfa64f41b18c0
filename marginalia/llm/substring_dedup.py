"""Removal of passages that an earlier document has, by repeated-phrase automata.

A window is WINDOW consecutive words of one document. A word goes if a window
that covers it also starts in a document with a smaller doc_id. Three passes
over buckets of documents (dealt out once, by doc_id):

1. Each bucket sends the fingerprints of its distinct windows, with the
   smallest doc_id that has each, to shards of the fingerprint space. A shard
   answers the bucket that owns a window (has its smallest doc_id) which other
   buckets have it too. A window in any number of documents is one entry a
   bucket, so a common passage doesn't pile up in its shard.
2. Owners confirm these recurring windows in their text, join them to
   passages, and send the passages to the buckets that asked.
3. Each bucket compiles the passages sent to it into Aho-Corasick automata
   over blocks of BLOCK words (any window of a passage holds a whole block at
   a multiple of BLOCK), in shards of AUTOMATON_BYTES, streams its documents
   through them, and at each hit checks the windows around it against the
   passages' own windows, word for word.

Fingerprints have 64 bits and only nominate: what is removed has been found as
text. Of two windows with one fingerprint (less than one pair is to be expected
in five billion windows) only the earlier's text is sent.

Cases: null or empty text has no words and the digest of nothing; documents
under WINDOW words lose none; windows that repeat in their own document only
stay; rows that share a doc_id are one document to each other; a null doc_id
counts as larger than all others; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import Words, bucketed, ids_of, ids_out, shuffle_partitions, text_buffers

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Bits of a fingerprint; a shard's number is its first ones.
BITS = 64
#: Pattern bytes of one automaton; a bucket with more passages uses several, one after the other.
AUTOMATON_BYTES = 2 << 20

ASK = "shard int, bucket int, ids binary, counts binary, prints binary"
ANSWER = "bucket int, prints binary, askers binary"
PASSAGE = "bucket int, owner long, passage binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _sorted_words(group: pa.Table) -> tuple[np.ndarray, Words]:
    """Ids in ascending order and the words of the texts in this order."""
    ids = ids_of(group.column("doc_id"))
    order = np.argsort(ids, kind="stable")
    group = group.take(pa.array(order))
    return ids[order], Words(*text_buffers(group.column("text")))


def _prints(words: Words, k: int, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints in ascending order, the first word of their first window, and of all windows fingerprint and first word."""
    h, at = words.windows(words.hashes(), k)
    h = h >> np.uint64(drop)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(s.size, bool)
    new[1:] = s[1:] != s[:-1]
    return s[new], at[order[new]], h, at


def layout(shard_bits: int) -> tuple[int, int, int]:
    """Bytes sent, bits below the shard's number, and bits of a hash that are dropped."""
    below = BITS - shard_bits
    return -(-below // 8), below, 64 - BITS


def _ask(k: int, shard_bits: int):
    width, below, drop = layout(shard_bits)

    def run(group: pa.Table) -> pa.Table:
        ids, words = _sorted_words(group)
        bucket = group.column("bucket")[0].as_py()
        prints, at, _, _ = _prints(words, k, drop)
        docs = words.doc[at]
        cut = np.searchsorted(prints, np.arange((1 << shard_bits) + 1, dtype=np.uint64)[:-1] << np.uint64(below))
        cut = np.append(cut, prints.size)
        rows: list[list] = [[], [], [], [], []]
        for shard in range(1 << shard_bits):
            i, j = cut[shard], cut[shard + 1]
            if i == j:
                continue
            order = np.argsort(docs[i:j], kind="stable")
            own, counts = np.unique(docs[i:j], return_counts=True)
            low = prints[i:j][order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            for x, v in zip(rows, (shard, bucket, np.diff(ids[own], prepend=0).tobytes(), counts.astype("<u4").tobytes(), np.ascontiguousarray(low).tobytes())):
                x.append(v)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(rows, kinds)], names=["shard", "bucket", "ids", "counts", "prints"])

    return run


def _answer(group: pa.Table, shard_bits: int) -> pa.Table:
    """For each window that several buckets have: its owner's bucket, and the others."""
    width, below, _ = layout(shard_bits)
    shard = group.column("shard")[0].as_py()
    prints, docs, buckets = [], [], []
    for bucket, ids, counts, low in zip(*(group.column(c).to_pylist() for c in ("bucket", "ids", "counts", "prints"))):
        wide = np.zeros((len(low) // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(low, np.uint8).reshape(-1, width)
        prints.append(wide.view("<u8").ravel())
        docs.append(np.repeat(np.cumsum(np.frombuffer(ids, np.int64)), np.frombuffer(counts, "<u4")))
        buckets.append(np.full(wide.shape[0], bucket, np.int32))
    h, doc, bucket = map(np.concatenate, (prints, docs, buckets))
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    shared = np.zeros(h.size, bool)
    shared[1:] |= same
    shared[:-1] |= same
    h, order = h[shared], order[shared]
    if not h.size:
        return pa.table({"bucket": pa.array([], pa.int32()), "prints": pa.array([], pa.binary()), "askers": pa.array([], pa.binary())})
    doc, bucket = doc[order], bucket[order]
    order = np.lexsort((bucket, doc, h))
    h, bucket = h[order], bucket[order]
    first = np.ones(h.size, bool)
    first[1:] = h[1:] != h[:-1]
    owner = bucket[np.flatnonzero(first)[np.cumsum(first) - 1]]
    ask = ~first
    h, owner, asker = h[ask] | np.uint64(shard << below), owner[ask], bucket[ask]
    order = np.argsort(owner, kind="stable")
    h, owner, asker = h[order], owner[order], asker[order]
    to, cut = np.unique(owner, return_index=True)
    cut = [*cut.tolist(), h.size]
    return pa.table(
        [
            pa.array(to, pa.int32()),
            pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
            pa.array([asker[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
        ],
        names=["bucket", "prints", "askers"],
    )


def _passages(k: int, shard_bits: int):
    drop = layout(shard_bits)[2]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int32()), "owner": pa.array([], pa.int64()), "passage": pa.array([], pa.binary())})
        if not docs.num_rows:
            return none
        own = docs.column("bucket")[0].as_py()
        ids, words = _sorted_words(docs)
        prints, at, h, every = _prints(words, k, drop)
        if not prints.size:
            return none
        # Windows that several documents of this bucket have.
        where = np.searchsorted(prints, h)
        local = np.zeros(prints.size, bool)
        np.logical_or.at(local, where, ids[words.doc[every]] != ids[words.doc[at]][where])
        asked, askers = [np.flatnonzero(local)], [np.full(int(local.sum()), own, np.int32)]
        for p, a in zip(answers.column("prints").to_pylist(), answers.column("askers").to_pylist()):
            asked.append(np.searchsorted(prints, np.frombuffer(p, np.uint64)))
            askers.append(np.frombuffer(a, np.int32))
        start, asker = at[np.concatenate(asked)], np.concatenate(askers)
        if not start.size:
            return none
        order = np.lexsort((start, asker))
        start, asker = start[order], asker[order]
        head = np.ones(start.size, bool)
        head[1:] = (asker[1:] != asker[:-1]) | (start[1:] - start[:-1] > 1) | (words.doc[start[1:]] != words.doc[start[:-1]])
        i = np.flatnonzero(head)
        j = np.append(i[1:], start.size) - 1
        raw = words.data.tobytes()
        a, b = words.start[start[i]].tolist(), words.end[start[j] + k - 1].tolist()
        return pa.table(
            [pa.array(asker[i], pa.int32()), pa.array(ids[words.doc[start[i]]], pa.int64()), pa.array([b" ".join(raw[x:y].split()) for x, y in zip(a, b)], pa.binary())],
            names=["bucket", "owner", "passage"],
        )

    return run


def windows_of(passages: list[bytes], owners: list[int], k: int) -> dict[bytes, int]:
    """The smallest owner of each window of the passages."""
    out: dict[bytes, int] = {}
    for p, owner in zip(passages, owners):
        ends = [i for i, c in enumerate(p) if c == 0x20] + [len(p)]
        starts = [0] + [e + 1 for e in ends[:-1]]
        for s, e in zip(starts, ends[k - 1 :]):
            w = p[s:e]
            if out.get(w, owner) >= owner:
                out[w] = owner
    return out


def automata(passages: list[bytes], k: int, limit: int = AUTOMATON_BYTES):
    """Automata over the passages' blocks of words, one at a time, each over about limit bytes."""
    block, seen, held, size = (k + 1) // 2, set(), [], 0
    for p in passages:
        words = p.split(b" ")
        for i in range(0, len(words) - block + 1, block):
            b = b" " + b" ".join(words[i : i + block]) + b" "
            if b not in seen:
                seen.add(b)
                held.append(b)
                size += len(b)
                if size >= limit:
                    yield _compiled(held)
                    held, size = [], 0
    if held:
        yield _compiled(held)


def _compiled(blocks: list[bytes]):
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for b in blocks:
        a.add_word(b.decode("latin-1"), len(b))
    a.make_automaton()
    return a


def _remove(k: int):
    block = (k + 1) // 2

    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        ids = ids_of(docs.column("doc_id"))
        data, bounds = text_buffers(docs.column("text")) if docs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        raw = data.tobytes()
        words = [raw[i:j].split() for i, j in zip(bounds.tolist(), bounds.tolist()[1:])]
        joined = [b" ".join(w) for w in words]
        covered = [None] * len(words)
        if sent.num_rows:
            passages = sent.column("passage").to_pylist()
            known = windows_of(passages, sent.column("owner").to_pylist(), k)
            lined = [f" {t.decode('latin-1')} " for t in joined]
            begins = [None] * len(words)
            tried = [None] * len(words)
            for automaton in automata(passages, k):
                for d, line in enumerate(lined):
                    if len(words[d]) < k:
                        continue
                    hits = [end - size + 1 for end, size in automaton.iter(line)]
                    if not hits:
                        continue
                    if begins[d] is None:
                        # Offsets of the words in the joined text; the line is one space ahead.
                        begins[d] = np.cumsum([0] + [len(w) + 1 for w in words[d]])
                        tried[d], covered[d] = np.zeros(len(words[d]), bool), np.zeros(len(words[d]), bool)
                    at = np.searchsorted(begins[d], np.array(hits))
                    near = (at[:, None] - np.arange(k - block + 1)).ravel()
                    near = np.unique(near[(near >= 0) & (near <= len(words[d]) - k)])
                    near = near[~tried[d][near]]
                    tried[d][near] = True
                    text, b, mine, mark = joined[d], begins[d], int(ids[d]), covered[d]
                    for i, s, e in zip(near.tolist(), b[near].tolist(), (b[near + k] - 1).tolist()):
                        if known.get(text[s:e], mine) < mine:
                            mark[i : i + k] = True
        removed = [0 if c is None else int(c.sum()) for c in covered]
        kept = [t if not r else b" ".join([w for w, c in zip(ws, cs) if not c]) for t, r, ws, cs in zip(joined, removed, words, covered)]
        return pa.table(
            [ids_out(ids), pa.array(list(map(len, words)), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return run


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    parts = shuffle_partitions(docs.sparkSession)
    shard_bits = max(2, min(30, (parts - 1).bit_length()))
    dealt = bucketed(docs, 4 * parts)
    asks = dealt.groupBy("bucket").applyInArrow(_ask(window, shard_bits), ASK)
    answers = asks.groupBy("shard").applyInArrow(lambda group: _answer(group, shard_bits), ANSWER)
    sent = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_passages(window, shard_bits), PASSAGE)
    return dealt.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_remove(window), RESULT)
