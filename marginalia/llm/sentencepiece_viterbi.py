"""SentencePiece ids by a streaming Viterbi search, and back to text.

The model file's pieces and scores are read as they are. For a model of merges
(BPE) the best path is the one that the merges would give, and it has a
property that a search from left to right can use: a sequence of pieces is
the model's encoding if and only if each two neighbours are, taken alone (their
joined text is encoded as these two). So each position has exactly one
backpointer, to the start of the one piece that can follow the path that ends
there; a test on pairs, remembered, replaces the score.

The search keeps a window only. Any later piece starts at most LONGEST
characters back, so only the paths that end there survive; as soon as all of
them run through one boundary, the ids before it are committed and the window
starts there. Between two words no piece lies across, so paths meet at each
word's start, and a table remembers the words' ids.

A character without a piece is committed as its UTF-8 bytes (byte pieces), or
as the unknown id if the model has none.

Cases: null text is empty and has no ids; an empty table gives no rows; very
long texts and very long words are encoded whole in bounded memory; other
columns are ignored; each row is encoded on its own, so ties and repeated
rows need no care.
"""

from __future__ import annotations

import gc
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import WordTable, Words, batches, gathered, thrifty

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MARK_BYTES = SPACE.encode()
ONLY_SPACE = np.zeros(256, bool)
ONLY_SPACE[0x20] = True
#: Characters after which the window of a long word is searched for a common boundary.
STRIDE = 256
#: Words whose ids a task remembers.
CACHE_WORDS = 1_000_000
#: Pairs of pieces whose test a worker remembers.
CACHE_PAIRS = 500_000


class Encoder:
    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in every]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in every]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {i: model.get_score(i) for i in self.ids.values()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        #: Characters that some piece has side by side; between others no piece lies.
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._automaton()
        #: What a piece reads as, if it stands alone: byte pieces above ASCII don't.
        self.reads = [chr(self.byte_of[k]) if k in self.byte_of else p.replace(SPACE, " ") for k, p in enumerate(self.pieces)]
        self.partial = {k for k, v in self.byte_of.items() if v >= 0x80}
        self.pairs: dict[int, bool] = {}
        self.remembered = lru_cache(50_000)(self.spaced)
        self.table = WordTable(lambda words: [self.spaced(w.decode()) for w in words], CACHE_WORDS)

    def _automaton(self) -> None:
        """An automaton over characters whose state knows all pieces that end here, the longest first."""
        self.children: list[dict[str, int]] = [{}]
        own: list = [None]
        for p, k in self.ids.items():
            at = 0
            for c in p:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    own.append(None)
                at = self.children[at][c]
            own[at] = (k, len(p))
        self.fail = [0] * len(own)
        self.ends: list[tuple] = [()] * len(own)
        todo = list(self.children[0].values())
        for at in todo:  # grows as it goes, level by level
            self.ends[at] = ((own[at],) if own[at] else ()) + self.ends[self.fail[at]]
            for c, to in self.children[at].items():
                f = self.fail[at]
                while f and c not in self.children[f]:
                    f = self.fail[f]
                self.fail[to] = self.children[f].get(c, 0)
                todo.append(to)
        #: State after each state and character met so far.
        self.moves: dict[int, int] = {}

    def _move(self, state: int, char: str) -> int:
        at = state
        while at and char not in self.children[at]:
            at = self.fail[at]
        at = self.children[at].get(char, 0)
        if len(self.moves) > CACHE_PAIRS:
            self.moves.clear()
        self.moves[state << 21 | ord(char)] = at
        return at

    def merged(self, text: str) -> list[int]:
        """Merge the neighbours with the best score, the leftmost first, until none is left; for tests of pairs."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return [self.ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may come after piece a (at the start if a is -1)."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            before = self.pieces[a] if a >= 0 else ""
            got = self.pairs[key] = self.merged(before + self.pieces[b]) == ([a, b] if a >= 0 else [b])
        return got

    def word(self, text: str) -> list[int]:
        """Ids of text, by the streaming search."""
        moves, all_ends, pairs, follows = self.moves, self.ends, self.pairs, self.follows
        out: list[int] = []
        base = 0  # the window's start: what is before has been committed
        last: list = [-1]  # piece that ends at base + i on the one path there; -1 nothing before; None no path
        state = 0
        for i, char in enumerate(text):
            found = None
            to = moves.get(state << 21 | ord(char))
            state = self._move(state, char) if to is None else to
            after = i + 1 - base
            for k, size in all_ends[state]:
                if size <= after:
                    before = last[after - size]
                    if before is not None:
                        ok = pairs.get(before << 32 | k)
                        if ok or ok is None and follows(before, k):
                            found = k
                            break
            if found is None and char not in self.ids:
                # No piece reaches across it: all paths meet before and after.
                out += self._back(base, i, last)
                out += self._fallback(char)
                base, last = i + 1, [-1]
                continue
            last.append(found)
            if after >= STRIDE and after % STRIDE == 0:
                cut = self._meeting(last)
                if cut > 0:
                    out += self._back(base, base + cut, last)
                    base, last = base + cut, last[cut:]
        return out + self._back(base, len(text), last)

    def _step(self, last: list, i: int) -> int:
        return i - len(self.pieces[last[i]])

    def _meeting(self, last: list) -> int:
        """The last boundary that the paths of all ends from which a later piece can start run through."""
        end = len(last) - 1
        ends = {i for i in range(max(0, end - self.longest + 1), end + 1) if last[i] is not None}
        while len(ends) > 1:
            i = max(ends)
            ends.discard(i)
            ends.add(self._step(last, i))
        return ends.pop()

    def _back(self, base: int, to: int, last: list) -> list[int]:
        ids, i = [], to - base
        while i > 0:
            ids.append(last[i])
            i -= len(self.pieces[last[i]])
        return ids[::-1]

    def _fallback(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode()]

    def spaced(self, word: str) -> list[int]:
        """Ids of a word with the mark of a space before it; the word has no space, but may start with more marks."""
        if word[-1:] in (",", ".") and len(word) > 1 and word[-2:] not in self.beside:
            # No piece lies across, so the word and its stop are encoded each for itself.
            return self.word(SPACE + word[:-1]) + self.word(word[-1])
        return self.word(SPACE + word)

    def _general(self, text: str) -> list[int]:
        """Ids of a text with any marks and spaces."""
        out, run = [], 0
        for p in text.replace(" ", SPACE).split(SPACE):
            # Marks in a row belong to one word: the pieces of several marks lie across them.
            if p:
                out += self.remembered(SPACE * run + p) if len(p) <= WordTable.LONG else self.spaced(SPACE * run + p)
                run = 0
            else:
                run += 1
        return out + self.word(SPACE * run) if run else out

    def flat(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        n = bounds.size - 1
        words = Words(data, bounds, ONLY_SPACE)
        pool, at, count = self.table.find(words)
        raw, ends = data.tobytes(), bounds.tolist()
        # Texts with one space between words are their words; the others are taken as a whole.
        other = np.diff(bounds) - np.diff(words.first) + 1 != np.bincount(words.doc, words.end - words.start, n).astype(np.int64)
        other &= np.diff(bounds) > 0
        for d in np.unique(np.searchsorted(bounds, [m.start() for m in re.finditer(MARK_BYTES, raw)], side="right") - 1).tolist():
            other[d] = True
        own = {d: np.array(self._general(raw[ends[d] : ends[d + 1]].decode()), np.int32) for d in np.flatnonzero(other).tolist()}
        if own:
            keep = ~other[words.doc]
            sizes = np.array([x.size for x in own.values()])
            place = np.searchsorted(words.doc[keep], list(own))
            at = np.insert(at[keep], place, pool.size + np.cumsum(sizes) - sizes)
            count = np.insert(count[keep], place, sizes)
            doc = np.insert(words.doc[keep], place, list(own))
            pool = np.concatenate([pool, *own.values()])
        else:
            doc = words.doc
        ids, _ = gathered(pool, at, count)
        return ids, np.bincount(doc, count, n).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.flat(data, np.array([0, data.size]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        if self.partial.isdisjoint(ids):
            text = "".join(map(self.reads.__getitem__, ids))
        else:
            out, held = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    held.append(b)
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(self.reads[i])
            text = "".join(out) + held.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str | None):
    def run(it):
        enc = encoder(path)
        gc.disable()  # millions of small tuples and no cycles
        try:
            for b, data, bounds in batches(it, 1 << 20):
                flat, sizes = enc.flat(data, bounds)
                at = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                listed, cut = flat.tolist(), at.tolist()
                raw, ends = data.tobytes(), bounds.tolist()
                same = [enc.decode(listed[i:j]) == raw[k:m].decode().replace(SPACE, " ") for i, j, k, m in zip(cut, cut[1:], ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), ids, pa.array(same, pa.bool_())], names=["doc_id", "ids", "round_trip"])
        finally:
            gc.enable()  # the worker goes on to other tasks
            enc.table.clear()

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and whether the ids decode to the text (in which the mark of a space reads as a space)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(thrifty(_encode(model)), "doc_id long, ids array<int>, round_trip boolean")


def _decode(path: str | None):
    def run(it):
        enc = encoder(path)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decode(model), "doc_id long, text string")


def _digest(it):
    for b in it:
        ids = b.column("ids")
        values = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(values[i:j].tobytes()) for i, j in zip(at, at[1:])], pa.int64()), b.column("round_trip")],
            names=["doc_id", "n_ids", "ids_crc32", "round_trip"],
        )


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_ids, crc32 of the ids as little-endian unsigned 32-bit integers, round_trip."""
    return rows.mapInArrow(_digest, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
