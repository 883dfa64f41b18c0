"""The text operators against brute force, on the smallest tables and on edge cases."""

import collections
import gc
import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from marginalia.llm import (
    context_tree,
    decontaminate,
    exact_dedup,
    language_id,
    near_dedup,
    queries,
    sentencepiece_viterbi,
    sharding,
    substring_dedup,
    token_orc,
    toxicity,
)
from marginalia.llm.common import Words, table, text_buffers

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}x" for k in range(60_000))
#: doc_id, text; nulls, empty texts, repeated rows, a shared doc_id, a null doc_id, very long texts.
ODD = [
    (0, None), (1, ""), (2, "  \t\n "), (3, "One two three four five six seven."), (4, "one two three four five six seven."), (5, "one two"), (6, "ONE two"),
    (7, LONG), (8, LONG + " end"), (9, "!!! ... 123"), (10, "same text again"), (10, "same text again"), (11, "a"), (11, "b c d e f g h i j k l m n o p q r s t"),
    (12, "b c d e f g h i j k l m n o p q r s t u v"), (None, "no id here at all"), (13, "é" * 3000), (14, "naïve Ünïcode ẞ   line   space"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, hits string, keep_id long, digest string, shard int"


@pytest.fixture(scope="module")
def odd(spark):
    """ODD with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None, 1, "x", 5, "y", 2) for k, (i, t) in enumerate(ODD)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(text):
    return WORD.findall(text or "")


# Shared arrays


def test_word_arrays():
    for sample in (["a b", "", " c\td ", "e"], [""], ["x" * 50, "  "], ["é ü\n", "z"]):
        import pyarrow as pa

        data, bounds = text_buffers(pa.array(sample))
        w = Words(data, bounds)
        got = [data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
        assert got == [x for t in sample for x in words(t)]
        assert w.doc.tolist() == [k for k, t in enumerate(sample) for _ in words(t)]


def twin_words(size=1024):
    """The Thue-Morse word of this size and its complement, which polynomials modulo 2**64 cannot tell apart."""
    t = "a"
    while len(t) < size:
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


def test_word_hashes():
    import pyarrow as pa

    r = random.Random(9)
    sample = {"".join(r.choice("ab") for _ in range(r.randint(1, 90))) for _ in range(3000)} | {"x" * n for n in range(1, 200)} | set(twin_words()) | set(twin_words(64)) | {"a\0", "a\0\0", "\0"}
    line = sorted(sample)
    got = {}
    for seed in (0, 1):
        w = Words(*text_buffers(pa.array([" ".join(line)])))
        got[seed] = w.hashes(seed).tolist()
        assert len(set(got[seed])) == len(line) == w.start.size
        # The same word has the same hash wherever it stands.
        for k in r.sample(range(len(line)), 50):
            assert Words(*text_buffers(pa.array(["y", f" {line[k]} z"]))).hashes(seed)[1] == got[seed][k]
    assert not set(got[0]) & set(got[1])


# 1 language identification


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 8):
        c = language_id.codewords(k)
        assert len({tuple(r) for r in c}) == k
    assert language_id.codewords(4).shape == (4, 7) and language_id.codewords(1).shape == (1, 1)


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    truth = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, odd, none, docs):
    model = language_id.fit(docs)
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        own = [t for i, t in ODD if i == r["doc_id"]]
        if not any(any(map(str.isalpha, t or "")) for t in own):
            assert r["lang_pred"] == "und" and r["score"] == 0 and r["ambiguous"]
    assert language_id.predict(none, model).count() == 0
    empty = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}
    single = language_id.fit(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.predict(docs.where("lang = 'de'"), single).collect()} == {"en"}


def test_language_scores_do_not_depend_on_batches(docs):
    import pyarrow as pa

    model = language_id.fit(docs)
    sample = [r["text"] for r in docs.limit(20).collect()]
    data, bounds = text_buffers(pa.array(sample))
    together = language_id.bits(model, data, bounds)
    for k, t in enumerate(sample):
        assert language_id.bits(model, *text_buffers(pa.array([t])))[0] == pytest.approx(together[k], abs=1e-4)


def test_language_equals_brute_force(docs):
    """Vectors from a dictionary of n-grams, and a loop over languages and bits."""
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for r in docs.limit(60).collect():
        raw = re.sub(b"[A-Z]+", lambda m: m[0].lower(), r["text"].encode())
        vector = np.zeros(language_id.BUCKETS)
        for size, first, wide in ((1, 0, 256), (2, 256, 1024), (3, 1280, language_id.BUCKETS - 1280)):
            for i in range(len(raw) - size + 1):
                g = raw[i : i + size]
                code = {1: lambda g: g[0], 2: lambda g: (g[0] * 257 + g[1]) * 2654435761 % 2**32 >> 22, 3: lambda g: (((g[0] * 65599 + g[1]) * 65599 + g[2]) * 2246822519 % 2**32 >> 16) % wide}[size](g)
                vector[first + code] += 1 / (len(raw) - size + 1)
        f = [sum(np.sqrt(vector) * model.weights[:, b]) + model.bias[b] for b in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-x * c)) * t for x, c, t in zip(f, model.code[k], model.trust[k])) for k in range(len(model.languages))]
        best = min(range(len(loss)), key=loss.__getitem__)
        near = sorted(loss)
        own = got[r["doc_id"]]
        assert own["score"] == pytest.approx(1 / sum(math.exp(-(x - near[0]) * len(f)) for x in loss), abs=1e-3)
        if near[1] - near[0] > 1e-3:
            assert own["lang_pred"] == model.languages[best]
        if abs(near[1] - near[0] - language_id.AMBIGUOUS_LEAD) > 1e-3:
            assert own["ambiguous"] == (near[1] - near[0] < language_id.AMBIGUOUS_LEAD)


def test_language_without_ids(spark):
    """Null doc_ids, one text in very many rows, and texts without a word, of which a piece holds many."""
    rows = [(None, f"the cat {k % 50} and the dog", "en") for k in range(3000)] + [(None, "der Hund und die Katze", "de")] * 3000 + [(None, None, "de")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = language_id.fit(df, per_language=20)
    got = collections.Counter((r["lang_pred"], r["doc_id"]) for r in language_id.predict(df, model).collect())
    assert got == {("en", None): 3000, ("de", None): 3000, ("und", None): 500}
    assert language_id.keep(df, model).count() == 6000


# 2 toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    odd_half = "pmod(hash(doc_id), 2) = 1"
    model = toxicity.fit(docs, labels.where(f"not {odd_half}"), queries.CATEGORIES)
    rows = toxicity.predict(docs, model).join(labels.where(odd_half), "doc_id").collect()
    flagged = [r for r in rows if r["p_toxic"] >= 0.5]
    assert sum(r["toxic"] for r in flagged) >= 0.95 * len(flagged)
    assert sum(r["toxic"] for r in flagged) >= 0.7 * sum(r["toxic"] for r in rows)
    assert model.links[1, 0] != 0 and (np.triu(model.links) == 0).all()


def test_toxicity_edges(spark, odd, none, docs):
    labels = table(spark, SF, "labels")
    model = toxicity.fit(docs, labels, queries.CATEGORIES)
    rows = toxicity.predict(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["p_toxic"] <= 1 for r in rows)
    assert toxicity.predict(none, model).count() == 0
    blank = toxicity.fit(docs, labels.where("false"), queries.CATEGORIES)
    assert max(r["p_toxic"] for r in toxicity.predict(docs, blank).collect()) < 1e-6
    toxicity.fit(odd, spark.createDataFrame([(3, 1, None), (4, 0, 0), (None, 1, 1), (10, 1, 1)], "doc_id long, quality int, toxic int"), queries.CATEGORIES)


def test_toxicity_equals_brute_force(docs, spark):
    """Sums over the distinct words of a text, category after category."""
    import pyarrow as pa

    model = toxicity.fit(docs, table(spark, SF, "labels"), queries.CATEGORIES)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    got = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    for r in docs.collect():
        seen = {int(b) for w in set(words(r["text"])) for b in toxicity.word_buckets(*text_buffers(pa.array([w])))[0]}
        p = []
        for c in range(len(model.categories)):
            logit = model.bias[c] + sum(weight[b][c] for b in seen if b in weight) + sum(x * model.links[c, d] for d, x in enumerate(p))
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
        assert [got[r["doc_id"]][f"p_{c}"] for c in model.categories] == pytest.approx(p, abs=1e-9)


# 3 passages


def passages_removed(rows):
    """doc -> removed flags, by brute force; rows are (id, text)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        c = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                c[j : j + 13] = [True] * 13
        out.append((None if i == 1 << 60 else i, len(w), sum(c), hashlib.sha256(" ".join(x for x, y in zip(w, c) if not y).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_passages(request, which):
    df = request.getfixturevalue(which)
    rows = [(1 << 60 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((tuple(r) for r in substring_dedup.dedup(df).collect()), key=repr) == passages_removed(rows)


def test_passages_of_random_texts(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(x) for x in substring_dedup.dedup(df).collect()), key=repr) == passages_removed(rows)


def test_passages_of_words_hard_to_tell_apart(spark):
    t, u = twin_words()
    head = " ".join(f"h{k}" for k in range(12))
    rows = [(1, f"{head} {t}"), (2, f"{head} {u}"), (3, f"{head} {u}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.dedup(df).collect())) == passages_removed(rows)


def test_automata_find_every_window():
    r = random.Random(1)
    passage = " ".join(r.choice("abc") for _ in range(40)).encode()
    blocks = {len(x) for a in substring_dedup.automata([passage], 13, 20) for x in [list(a.keys())]}
    assert blocks
    w = passage.split()
    known = substring_dedup.windows_of([passage], [3], 13)
    assert set(known) == {b" ".join(w[i : i + 13]) for i in range(28)}


# 4 near copies


def near_components(rows, percent):
    """id -> smallest id reachable, by brute force."""
    sets = [(i, near_dedup.shingles((t or "").encode())) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, s), (j, t) in itertools.combinations(sets, 2):
        both = len(s & t)
        if both and 100 * both >= percent * (len(s) + len(t) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
@pytest.mark.parametrize("percent", [85, 60])
def test_near_copies(request, which, percent):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = near_components(rows, percent)
    got = near_dedup.dedup(df, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = collections.Counter((i, len(near_dedup.shingles((t or "").encode()))) for i, t in rows)
    assert sizes == collections.Counter((r["doc_id"], r["n_shingles"]) for r in got)
    assert near_dedup.keep(df, percent).columns == df.columns


def test_near_copies_without_a_common_hub(spark):
    """Copies of one text with more and more edits: chains of links, and copies that link to none."""
    r = random.Random(8)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[r.randrange(150)] = f"e{r.randrange(10**6)}"
        rows.append((k * 3 % 121, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.dedup(df, 85).collect()}
    assert got == near_components(rows, 85)


def test_near_copies_in_one_large_group(spark, monkeypatch):
    """Copies of one text with many edits, in tiles of a few: far fewer links are sent than documents."""
    monkeypatch.setattr(near_dedup, "TILE_DOCS", 40)
    r = random.Random(11)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(500):
        w = list(base)
        for _ in range(r.choice([1, 2, 2, 3, 3, 4])):
            w[r.randrange(120)] = f"e{r.randrange(40)}"
        rows.append((k * 7 % 503, " ".join(w)))
    sent, confirmed = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *a: sent.append(pairs.count()) or confirmed(pairs, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.dedup(df, 85).collect()}
    assert got == near_components(rows, 85)
    hubs, loose = sent
    assert loose <= 10 * len(rows) < len(rows) ** 2 / 20


def test_near_copies_when_hashes_collide(spark, monkeypatch):
    """Links that the texts refute make the tiles run again with another hash."""
    plain, seeds = Words.hashes, []
    monkeypatch.setattr(Words, "hashes", lambda self, seed=0: plain(self, seed) if seed != 0 or not seeds else plain(self, 0) % np.uint64(3))
    monkeypatch.setattr(near_dedup, "_shingle_hashes", (lambda f: lambda k, seed: seeds.append(seed) or f(k, seed))(near_dedup._shingle_hashes))
    test_near_copies_without_a_common_hub(spark)
    assert seeds[0] == 0


def test_shingles_of_words_hard_to_tell_apart(spark):
    t, u = twin_words()
    w = [f"w{k}" for k in range(9)]
    df = spark.createDataFrame([(1, " ".join([*w[:4], t, *w[:4], u]))], "doc_id long, text string")
    assert near_dedup.dedup(df).first()["n_shingles"] == 6


@pytest.mark.parametrize("common", [64, 3])
def test_intersections_and_forests(monkeypatch, common):
    monkeypatch.setattr(near_dedup, "COMMON", common)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(30)]
    got = near_dedup.intersections(sets)
    assert all(got[i, j] == np.intersect1d(sets[i], sets[j]).size for i in range(30) for j in range(30) if i != j)
    comp = r.integers(0, 12, 30)
    linked = r.random((30, 30)) < 0.05
    linked = (linked | linked.T) & (comp[:, None] != comp[None, :])
    edges = near_dedup.forest(linked, comp)
    assert all(linked[i, j] for i, j in edges)

    def classes(pairs):
        root = {c: c for c in comp.tolist()}
        for a, b in pairs:
            x, y = root[comp[a]], root[comp[b]]
            root = {k: x if v == y else v for k, v in root.items()}
        return root

    some, every = classes(edges), classes(zip(*map(np.ndarray.tolist, np.nonzero(linked))))
    assert {(some[a] == some[b]) == (every[a] == every[b]) for a in some for b in some} == {True}
    assert len(edges) == len(set(comp.tolist())) - len(set(some.values()))


def test_min_and_max_estimate_similarity():
    import pyarrow as pa

    a = [f"q{k}" for k in range(400)]
    b = a[:360] + [f"z{k}" for k in range(40)]
    h, at = (w := Words(*text_buffers(pa.array([" ".join(a), " ".join(b)])))).windows(w.hashes(), 5)
    x, y = near_dedup.signature_values(h, np.searchsorted(w.doc[at], [0, 1]), 150)
    s, t = near_dedup.shingles(" ".join(a).encode()), near_dedup.shingles(" ".join(b).encode())
    assert x.size == 300 and (x == y).mean() == pytest.approx(len(s & t) / len(s | t), abs=0.12)
    assert near_dedup.bands_for(85) == 24 and (1 - 0.8**5) ** near_dedup.bands_for(80) <= 1e-6


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r["doc"]: r["comp"] for r in near_dedup.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


# 5 token files


def test_words_encode_like_texts(texts):
    enc = token_orc.encoder(None)
    r = random.Random(2)
    letters = "abcdehtionABCÉÀßµªºſKİÅΣσς  \n\t.,'s'LL-_▁éß中😀́\x00\x1c\x85  xX12<|endoftext|>"
    samples = [*texts.values(), *("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)), "<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>"]
    import pyarrow as pa

    data, bounds = text_buffers(pa.array(samples))
    for _ in range(2):  # the second time from the table
        flat, sizes = enc.flat(data, bounds, 2)
    cut = [0, *np.cumsum(sizes).tolist()]
    for t, i, j in zip(samples, cut, cut[1:]):
        assert flat[i:j].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_token_files(request, spark, which):
    df = request.getfixturevalue(which)
    at = token_orc.new_path(spark)
    token_orc.write(df, at)
    rows = token_orc.read(spark, at).orderBy("start").collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tok, start = token_orc.encoder(None).tokenizer, 0
    assert len(rows) == len(want)
    for r, (i, t) in zip(rows, want):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["ids"]) == (i, start, ids)
        start += len(ids)
    if which == "docs":
        d = {r["doc_id"]: r["ids_crc32"] for r in token_orc.digest(token_orc.read(spark, at)).collect()}
        assert all(d[r["doc_id"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
        assert [r["doc_id"] for r in token_orc.lookup(spark, at, [17]).collect()] == [17]


# 6 SentencePiece


def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(texts):
    lib, enc = library(), sentencepiece_viterbi.encoder()
    r = random.Random(1)
    letters = "abcdehtion  \n\t.,▁éß中😀\x00xX12 "
    samples = [*texts.values(), *("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(5000))]
    samples += ["two  spaces", " first", "last ", "a▁b ▁ c", "x" * 200 + " y", "a" * 5000, "the" * 3000, " " * 3000, "ab" * 2000 + "é" * 1000, "", " ", "▁"]
    for t in samples:
        ids = enc.encode(t)
        assert ids == lib.encode(t)
        assert enc.decode(ids) == t.replace("▁", " ")


def test_window_stays_bounded():
    enc = sentencepiece_viterbi.encoder()
    cuts = []
    meeting = enc._meeting
    enc._meeting = lambda last: cuts.append(len(last)) or meeting(last)
    try:
        enc.word("internationalization" * 2000)
    finally:
        del enc._meeting
    assert len(cuts) > 100 and max(cuts) <= 2 * sentencepiece_viterbi.STRIDE


HELD = """
import re, sys
import pyarrow as pa
from marginalia.llm import exact_dedup, language_id

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches(n, rows):
    for k in range(n):
        yield pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array([f"{k} {i} " + "word " * 400 for i in range(rows)]), pa.array(["en"] * rows)], names=["doc_id", "text", "lang"])

run = {"digests": exact_dedup._map_digests, "vectors": language_id._features}[sys.argv[1]]
sum(x.num_rows for x in run(batches(1, 100)))
before = held()
rows = sum(x.num_rows for x in run(batches(2, 10_000)))
print(rows, held() - before)
"""


@pytest.mark.parametrize("what", ["digests", "vectors"])
def test_a_worker_gives_back_what_a_task_took(what):
    said = subprocess.run([sys.executable, "-c", HELD, what], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(__file__)))})
    rows, more = said.stdout.split()
    assert int(rows) == 20_000 and float(more) < 10


def test_pieces_leave_a_worker_as_it_was():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", None])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in sentencepiece_viterbi._encode(None)(iter([batch]))) == 2
    assert gc.isenabled() and not sentencepiece_viterbi.encoder().table.keys.size


def test_pieces_edges(odd, none):
    rows = sentencepiece_viterbi.encode(odd)
    back = sentencepiece_viterbi.decode(rows).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in back) == sorted((i is None, i or 0, t or "") for i, t in ODD)
    assert rows.where("not round_trip").count() == 0 and sentencepiece_viterbi.encode(none).count() == 0
    assert sentencepiece_viterbi.digest(rows).where("doc_id = 1").first()["n_ids"] == 0


# 7 decontamination


def overlaps(text, item, window=13, percent=80):
    """Whether an overlay of the word lists agrees enough somewhere, by brute force."""
    split = lambda t: [x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]
    h, it = split(text), split(item)
    w = min(window, len(it))
    there = set(h)
    if not w or sum(x in there for x in it) * 100 < percent * w:
        return False  # the text has too few of the item's words anywhere
    for s in range(-(len(it) - w), len(h) - w + 1):
        low, high = max(0, -s), min(len(it), len(h) - s)
        same = [it[j] == h[j + s] for j in range(low, high)]
        if any(sum(same[i : i + w]) * 100 >= percent * w for i in range(len(same) - w + 1)):
            return True
    return False


def test_masks_hit_every_window_with_two_replaced_words():
    for gone in itertools.combinations(range(13), 2):
        assert any(not {i + p for p in m} & set(gone) for m in decontaminate.MASKS for i in range(13 - 8))


def test_masks_of_short_items_hit_every_overlay():
    for n in range(1, 13):
        masks = decontaminate.short_masks(n)
        for gone in itertools.combinations(range(n), n - -(-n * decontaminate.PERCENT // 100)):
            assert any(not set(m) & set(gone) for m in masks)
        assert all(m for m in masks)


def leaky(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (20, 13, 12, 10, 9, 8, 5, 3, 1, 40)]
    docs = []
    for k in range(120):
        it = list(r.choice(items))
        at = r.randrange(len(it))
        it = it[at:][: r.randint(5, 30)] if r.random() < 0.3 else it
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            it[r.randrange(len(it))] = word()
        docs.append((k, " ".join([*(word() for _ in range(r.randint(0, 30))), *it, *(word() for _ in range(r.randint(0, 30)))]).title() + "."))
    docs.append((None, docs[0][1]))
    bench = [(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
        monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", 0)
    docs, bench = leaky(spark)
    items = [(b["item_id"], b["text"]) for b in bench.collect()]
    want = {r["doc_id"]: {i for i, t in items if overlaps(r["text"], t)} for r in docs.collect()}
    got = {r["doc_id"]: set(r["item_ids"] or []) for r in decontaminate.flagged(docs, bench).collect()}
    assert got == want and any(want.values()) and not all(want.values())
    assert {i for v in want.values() for i in v} == set(range(10))
    assert {r["doc_id"] for r in decontaminate.keep(docs, bench).collect()} == {i for i, v in got.items() if not v}


def test_contamination_sql(spark):
    """The registered SQL, which knows no masks, on items of all lengths."""
    import duckdb

    docs, bench = leaky(spark)
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null").toArrow())
    con.register("benchmark", bench.toArrow())
    answer = con.execute(queries.oracle_sql()["op7_decontaminate"])
    names = [d[0] for d in answer.description]
    got = decontaminate.flagged(docs.where("doc_id is not null"), bench).withColumn("kept", ~F.col("contaminated")).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(answer.fetchall())


def test_contamination_of_a_long_text(spark):
    """One text with an item ten thousand times, and rows that share an id."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    df = spark.createDataFrame([(1, " ".join(f"{item} x{k}" for k in range(10_000))), (2, "clean"), (2, item), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.matches(df, bench).collect()}
    assert found.keys() == {1, 2} and found[1]["n_overlaps"] == 10_000
    assert sorted(r["text"] or "" for r in decontaminate.keep(df, bench).collect()) == ["", "clean"]


def test_contamination_edges(spark, odd, none):
    bench = table(spark, SF, "benchmark")
    assert decontaminate.flagged(odd, bench).where("contaminated").count() == 0
    assert decontaminate.flagged(odd, bench).count() == len(ODD)
    assert decontaminate.flagged(none, bench).count() == 0
    assert decontaminate.flagged(odd, bench.where("false")).where("contaminated").count() == 0


# 8 context trees


def test_probabilities_sum_to_one(docs):
    model = context_tree.fit(docs.limit(40))
    r = np.random.default_rng(0)
    for context in (b"\xff" * 5, b"n the", b"zqzqz", bytes(r.integers(0, 256, 5).tolist())):
        code = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10.0 ** context_tree.log10_probabilities(model, code)).sum() == pytest.approx(1.0)


def test_block_probability_is_sequential():
    zeros, ones, p = 0, 0, 0.0
    for bit in (1, 0, 0, 1, 1, 1, 0):
        p += math.log(((ones if bit else zeros) + 0.5) / (zeros + ones + 1))
        ones, zeros = ones + bit, zeros + 1 - bit
    assert context_tree.block(np.array([zeros * 1.0]), np.array([ones * 1.0]))[0] == pytest.approx(p)


def test_strings_and_scores_by_hand(spark):
    import pyarrow as pa

    data, bounds = text_buffers(pa.array(["aB", "", "c"]))
    code, begin = context_tree.strings(data, bounds)
    want = [b"\xff" * 5 + b"a", b"\xff" * 4 + b"ab", b"\xff" * 3 + b"ab\xff", b"\xff" * 6, b"\xff" * 5 + b"c", b"\xff" * 4 + b"c\xff"]
    assert code.tolist() == [int.from_bytes(x, "big") for x in want] and begin.tolist() == [0, 3, 4]


def test_model_equals_trees_by_hand(spark):
    """All nodes and weights from dictionaries, on short texts."""
    r = random.Random(6)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(0, 40))) for _ in range(30)]
    depth, counts = context_tree.DEPTH, collections.Counter()
    for t in texts:
        line = b"\xff" * depth + t.encode() + b"\xff"
        for i in range(depth, len(line)):
            for k in range(8):
                node, bit = (1 << k) | (line[i] >> (8 - k)), line[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts[line[i - d : i], node, bit] += 1
    nodes = {(c, u) for c, u, _ in counts}
    kt = {x: context_tree.block(np.array([counts[*x, 0] * 1.0]), np.array([counts[*x, 1] * 1.0]))[0] for x in nodes}
    below, total = collections.Counter(), {}
    for c, u in sorted(nodes, key=lambda x: -len(x[0])):
        total[c, u] = kt[c, u] if len(c) == depth else np.logaddexp(kt[c, u], below[c, u]) - math.log(2)
        below[c[1:], u] += total[c, u] if c else 0
    model = context_tree.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    for _ in range(200):
        line = bytes(r.choice(b"abc \xff") for _ in range(depth)) + bytes([r.choice(b"abcd \xff")])
        want = 0.0
        for k in range(8):
            u, bit = (1 << k) | (line[-1] >> (8 - k)), line[-1] >> (7 - k) & 1
            p = None
            for d in range(depth, -1, -1):
                x = (line[depth - d : depth], u)
                n0, n1 = counts[*x, 0], counts[*x, 1]
                if n0 + n1 >= (context_tree.LEAST if d > 1 else 1):
                    own = math.exp(kt[x] - math.log(2) - total[x]) if d < depth else 1.0
                    one = (n1 + 0.5) / (n0 + n1 + 1)
                    p = one if p is None else own * one + (1 - own) * p
            p = 0.5 if p is None else p
            want += math.log10(p if bit else 1 - p)
        got = context_tree.log10_probabilities(model, np.array([int.from_bytes(line, "big")], np.uint64))[0]
        assert got == pytest.approx(want, abs=1e-3)


def test_contexts_met_once_count(spark):
    model = context_tree.fit(spark.createDataFrame([("aaex",), ("bbey",)], "text string"))
    seen, other = context_tree.log10_probabilities(model, np.array([int.from_bytes(b"\xff\xffaae" + x, "big") for x in (b"x", b"y")], np.uint64))
    # x and y differ in the last bit alone: 3/4 in contexts of two bytes and more, which one byte (weight 1/3) and none (2/5) draw towards 1/2.
    assert seen - other == pytest.approx(math.log10(0.6 / 0.4))


def test_every_node_is_found(spark):
    """In a table of millions of nodes, each string of some contexts has the probability of trees from dictionaries."""
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    model = context_tree.fit(table(spark, "/root/testdata/sf0.01", "documents"))
    data = b"".join(b"\xff" * 5 + re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").encode() + b"\xff" for t in texts)
    top = [dict(zip(keys.tolist(), zip(one.tolist(), own.tolist()))) for _, keys, one, own in model.top]
    for near in (b"qu", b"ie"):
        runs = collections.Counter(data[m.start() - 3 : m.start() + 3] for m in re.finditer(b"(?=" + near + b")", data))
        counts = collections.Counter()
        for run, n in runs.items():
            for k in range(8):
                for d in range(2, 6):
                    counts[run[5 - d : 5], (1 << k) | (run[5] >> (8 - k)), run[5] >> (7 - k) & 1] += n
        nodes = sorted({(c, u) for c, u, _ in counts}, key=lambda x: -len(x[0]))
        n0, n1 = (np.array([counts[*x, b] * 1.0 for x in nodes]) for b in (0, 1))
        kt = dict(zip(nodes, context_tree.block(n0, n1).tolist()))
        below, total = collections.Counter(), {}
        for c, u in nodes:
            total[c, u] = kt[c, u] if len(c) == 5 else np.logaddexp(kt[c, u], below[c, u]) - math.log(2)
            below[c[1:], u] += total[c, u]
        want = []
        for run in runs:
            log = 0.0
            for k in range(8):
                u, bit = (1 << k) | (run[5] >> (8 - k)), run[5] >> (7 - k) & 1
                p = 0.5
                for d in range(5, 1, -1):
                    c = run[5 - d : 5]
                    own = math.exp(kt[c, u] - math.log(2) - total[c, u]) if d < 5 else 1.0
                    p += own * ((counts[c, u, 1] + 0.5) / (counts[c, u, 0] + counts[c, u, 1] + 1) - p)
                for d, nodes_of in zip((1, 0), top):
                    one, own = nodes_of[d << 60 | (run[4] << 8 if d else 0) | u]
                    p += own * (one - p)
                log += math.log10(p if bit else 1 - p)
            want.append(log)
        got = context_tree.log10_probabilities(model, np.array([int.from_bytes(x, "big") for x in runs], np.uint64))
        assert len(runs) > 300 and np.allclose(got, want, atol=1e-6)


def test_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op8_context_tree(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    low = lambda t: words(re.sub("[A-Z]+", lambda m: m[0].lower(), t))
    train = [low(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(itertools.chain(*train))
    count[None] = len(train)
    n, v = sum(count.values()), len(count)
    for i, t in texts.items():
        tokens = [*low(t), None]
        r = rows[i]
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(count[x] > 0 for x in tokens) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + 1 * (v + 1))) for x in tokens), rel=1e-9)
    held = [r for r in rows.values() if r["held_out"]]
    # On a table this small whole words say about as much as bytes (the tree is ahead from some 20 MB on).
    assert sum(r["score"] for r in held) > 1.03 * sum(r["base_score"] for r in held)
    assert all(0.5 < r["bits_per_byte"] < 4 for r in held if r["n_tokens"] > 200)


def test_scores_edges(odd, none):
    rows = context_tree.score(odd, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == len(ODD) and all(r["score"] < 0 and r["base_score"] <= 0 for r in rows)
    assert context_tree.score(none, F.lit(True)).count() == 0
    blank = context_tree.score(odd, F.lit(False)).where("doc_id = 1").first()
    assert blank["n_known"] == 0 and blank["score"] == pytest.approx(8 * math.log10(0.5))


def test_scores_of_words_hard_to_tell_apart(spark):
    t, u = twin_words()
    df = spark.createDataFrame([(1, t), (2, u)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_known"] for r in context_tree.score(df, F.col("doc_id") == 1).collect()}
    assert got == {1: 2, 2: 1}


# 9 copies


def test_cuckoo_index_keeps_exactly_its_live_keys():
    r = random.Random(3)
    index, live = exact_dedup.CuckooIndex(2), {}
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for _ in range(12000):
        k = r.choice(keys)
        if k in live and r.random() < 0.4:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            live[k] = [r.random(), 1]
            index.insert(k, live[k])
        assert index.find(k) == live.get(k)
    assert len(index) == len(live) and index.resizes > 0 and not index.delete(b"\0" * 32)
    assert all(index.find(k) == live.get(k) for k in keys)


def test_cuckoo_hits_are_verified():
    index = exact_dedup.CuckooIndex(1)
    a, b = b"\x01\x00" + b"\0" * 30, b"\x01\x00" + b"\0" * 29 + b"\x01"
    index.insert(a, [1, 1])
    assert index.find(b) is None


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_copies(request, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"] or "")) for r in df.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = []
    for i, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, exact_dedup.dedup(df).collect()), key=repr) == sorted(want, key=repr)
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.keep(df).collect()]
    assert len(kept) == len(groups) == len(set(kept)) and exact_dedup.keep(df).columns == df.columns


# 10 shards


def rows_of(df, columns):
    return collections.Counter(map(tuple, df.select(columns).collect()))


def test_shards(spark, docs, odd, none, tmp_path):
    t = sharding.ShardTable(spark, str(tmp_path / "t"), target=1 << 20)
    assert t.append(docs.repartition(12)) == 1 and t.append(docs.limit(5)) == 2
    before = t.manifest()[0]
    version = t.compact()
    after = t.manifest()[0]
    assert version >= 3 and len(after) < len(before) and sum(s.rows for s in after) == sum(s.rows for s in before) == docs.count() + 5
    assert rows_of(t.read(), docs.columns) == rows_of(t.read(2), docs.columns) == rows_of(docs.union(docs.limit(5)), docs.columns)
    assert t.compact() == version
    with pytest.raises(sharding.LostCommit, match="exist"):
        t._commit(version, [], "{}")
    assert t.vacuum() > 0 and t.vacuum() == 0 and rows_of(t.read(), docs.columns) == rows_of(docs.union(docs.limit(5)), docs.columns)
    u = sharding.ShardTable(spark, str(tmp_path / "u"))
    u.append(odd)
    assert u.read().count() == len(ODD)
    v = sharding.ShardTable(spark, str(tmp_path / "v"))
    v.append(none)
    v.compact()
    assert v.read().count() == 0


def test_arrivals_climb_tiers(spark, docs, tmp_path):
    """Each row is written once a tier at most, and only shards of one tier are merged."""
    t = sharding.ShardTable(spark, str(tmp_path / "t"))
    written, merges, run = 0, [], sharding.ShardTable._change
    t._change = lambda gone, added, schema: merges.append((gone, added)) or run(t, gone, added, schema)
    for k in range(21):
        t.append(docs.where(F.col("doc_id") % 21 == k).coalesce(1))
        t.compact()
    live = t.manifest()[0]
    assert t.version() == 21 + 5 + 1 and collections.Counter(s.tier for s in live) == {0: 1, 1: 1, 2: 1}
    for gone, added in merges:
        written += sum(s.rows for s in added)
        if gone:
            assert len(gone) >= sharding.FAN and len({s.tier for s in gone}) == 1 and [s.tier for s in added] == [gone[0].tier + 1]
    assert written <= docs.count() * 3 and sum(s.rows for s in live) == docs.count()
    assert rows_of(t.read(), docs.columns) == rows_of(docs, docs.columns)


def test_plan_fills_targets():
    t = sharding.ShardTable.__new__(sharding.ShardTable)
    t.target = 1000
    shard = lambda k, n, tier: sharding.Shard(f"p{k:03d}", n, 1, tier, 1)
    assert t.plan([shard(k, 100, 1) for k in range(3)] + [shard(9, 600, 1), shard(10, 10, 0)]) == []
    runs = t.plan([shard(k, 100, 1) for k in range(25)] + [shard(30, 90, 0)])
    assert list(map(len, runs)) == [10, 10, 5] and {s.tier for r in runs for s in r} == {1}
    assert list(map(len, t.plan([shard(k, 100, 1) for k in range(22)]))) == [10, 10]
    assert list(map(len, t.plan([shard(k, 499, 1) for k in range(5)]))) == [2, 2]


def test_lost_commits_are_made_anew(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    one, two = sharding.ShardTable(spark, path), sharding.ShardTable(spark, path)
    first = docs.limit(10)
    plain, raced = sharding.ShardTable._commit, []

    def race(version, shards, schema):
        if not raced:
            raced.append(two.append(first))
        plain(one, version, shards, schema)

    one._commit = race
    assert one.append(first) == 2 and raced == [1] and one.read().count() == 20
    for _ in range(2):
        two.append(first)
    # A merge that another writer has done in the meantime is given up.
    raced.clear()

    def race_merge(version, shards, schema):
        if not raced:
            raced.append(two.compact())
        plain(one, version, shards, schema)

    one._commit = race_merge
    assert one.compact() == raced[0] and one.read().count() == 40 and len(one.manifest()[0]) == 1


def test_sharding_query(spark):
    import duckdb

    sf, made = "/root/testdata/sf0.01", []
    plain = sharding.ShardTable.read
    sharding.ShardTable.read = lambda self, *a: made.append(self) or plain(self, *a)
    try:
        df = queries.op10_sharding(spark, sf)
    finally:
        sharding.ShardTable.read = plain
    assert made[0].version() > queries.ARRIVALS and len({s.tier for s in made[0].manifest()[0]}) > 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    answer = con.execute(queries.oracle_sql()["op10_sharding"])
    assert sorted(map(tuple, df.select([d[0] for d in answer.description]).collect())) == sorted(answer.fetchall())


def test_tiers():
    assert [sharding.tier_of(n, 4, 4) for n in (0, 3, 4, 15, 16, 63, 64)] == [0, 0, 1, 1, 2, 2, 3]


# The pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    bench = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        now = stage(spark, now, SF)
        after = {r["doc_id"] for r in now.collect()}
        if name == "language_id":
            # Only documents without a letter go.
            assert after == {i for i, t in before if any(map(str.isalpha, t))}
        if name == "exact_dedup":
            groups = collections.defaultdict(list)
            for i, t in before:
                groups[re.sub("[A-Z]+", lambda m: m[0].lower(), t)].append(i)
            assert after == {max(g) for g in groups.values()}
        if name == "near_dedup":
            assert after == set(near_components(before, 80).values())
        if name == "decontamination":
            assert after == {i for i, t in before if not any(overlaps(t, b) for b in bench)}
        if name != "sentencepiece":
            assert now.columns == docs.columns
    lib = library()
    texts = dict(before)
    assert {r["doc_id"]: r["ids"] for r in now.collect()} == {i: lib.encode(t) for i, t in texts.items()}


@pytest.mark.parametrize("which", ["odd", "none"])
def test_pipeline_stages_edges(request, spark, which):
    """Nulls, empty and very long texts, repeated rows, an empty table and clashing names, stage by stage."""
    import corpus_pipeline

    df = request.getfixturevalue(which).withColumn("marginalia_lang", F.lit(1)).withColumn("marginalia_digest", F.lit(None).cast("string")).withColumn("print", F.lit(2))
    now = df
    for name, stage in corpus_pipeline.STAGES:
        before = collections.Counter((r["doc_id"], r["text"]) for r in now.collect())
        now = stage(spark, now, SF)
        if name == "sentencepiece":
            lib = library()
            assert sorted(map(repr, ((r["doc_id"], list(r["ids"])) for r in now.collect()))) == sorted(map(repr, ((i, lib.encode(t or "")) for i, t in before.elements())))
            break
        after = collections.Counter((r["doc_id"], r["text"]) for r in now.collect())
        assert now.columns == df.columns
        if name == "language_id":
            assert after == collections.Counter({k: n for k, n in before.items() if any(map(str.isalpha, k[1] or ""))})
        if name == "exact_dedup":
            groups = collections.defaultdict(list)
            for i, t in before:
                groups[re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")].append(i)
            largest = {t: max((x for x in g if x is not None), default=None) for t, g in groups.items()}
            assert {(i, re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for i, t in after} == {(i, t) for t, i in largest.items()} and set(after.values()) <= {1}
        if name == "near_dedup":
            comp = near_components(list(before), 80)
            assert after == collections.Counter({(i, t): n for (i, t), n in before.items() if i is None or comp[i] == i})
        if name == "decontamination":
            assert after == before


def test_pipeline_run(spark):
    """The whole run, against its stages' brute-force versions one after the other."""
    import corpus_pipeline

    rows = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    bench = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    rows = {i: t for i, t in rows.items() if any(map(str.isalpha, t))}
    last = {re.sub("[A-Z]+", lambda m: m[0].lower(), t): i for i, t in sorted(rows.items())}
    rows = {i: rows[i] for i in last.values()}
    rows = {i: rows[i] for i in set(near_components(sorted(rows.items()), 80).values())}
    rows = {i: t for i, t in rows.items() if not any(overlaps(t, b) for b in bench)}
    lib = library()
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: lib.encode(t) for i, t in rows.items()} and len(got) == len(rows)


def test_oracle_sql_of_copies(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    answer = con.execute(queries.oracle_sql()["op9_exact_dedup"])
    names = [d[0] for d in answer.description]
    got = [tuple(r[n] for n in names) for r in queries.op9_exact_dedup(spark, SF).collect()]
    assert sorted(got) == sorted(answer.fetchall())
