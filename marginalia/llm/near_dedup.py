"""Near-duplicate documents by min-max hashing, with exact confirmation.

The set of a document is its distinct SHINGLE-word shingles of lowered words.
Each permutation gives two values of the signature, the least and the largest
hash of the set, so half the permutations suffice. Bands of ROWS values are
joined; the number of bands follows from the threshold so that a pair at the
threshold is missed with a probability under MISS.

1. Documents with the same word sequence fall into one class (a 128-bit
   digest); its smallest doc_id stands for it from here on.
2. In each band the smallest document is the hub; all others are compared
   with it on their full sets, and components of the confirmed links formed.
3. Documents of bands that still hold several components are loose. Two of
   them can reach the threshold only if they share one of the rarest shingles
   of each (the prefix of its set in the order of document counts, as long as
   the threshold allows differences); copies with many edits have rare
   shingles of their own and meet no one. Loose documents that share such a
   shingle with another component meet in their open bands, in tiles of
   TILE_DOCS documents. A tile counts the intersections of all their sets by
   postings, and gives a spanning forest of the components that it links, so
   that a group of any size sends fewer links than it has documents.
4. The links of the forests are confirmed on the texts. If one is not, which
   takes a collision of hashes, the tiles run again with another hash.

Components come from alternating large-star and small-star steps, with a
table in the shared folder after each; nothing is gathered on the driver.

Cases: null text or text without words has an empty set and links to nothing;
fewer than SHINGLE words are one shingle, the whole sequence; rows that share
a doc_id are one document of the graph, so they share a component (n_shingles
is each row's own); a null doc_id links to nothing and is kept; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER, Words, batches, give_back, mix, release, stored, thrifty

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
ROWS = 5
MISS = 1e-6
#: Documents of one side of a tile, about, and shingles of all their sets.
TILE_DOCS, TILE_SHINGLES = 1000, 1 << 20
#: Shingles that so many documents of a tile have are counted by matrices, others pair by pair.
COMMON = 64

SIGNATURES = "doc_id long, n_shingles long, sequence binary, bands array<long>"
SETS = "doc long, comp long, key long, n int, rare array<long>, shingles array<long>"


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def signature_values(h: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """The least and the largest value of each set under each permutation; the sets lie in h one after the other."""
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    values = np.zeros((first.size, 2 * permutations), np.uint64)
    for p in range(permutations if first.size else 0):
        v = h * factor[p] + offset[p]
        v ^= v >> np.uint64(32)
        values[:, 2 * p] = np.minimum.reduceat(v, first)
        values[:, 2 * p + 1] = np.maximum.reduceat(v, first)
    return values


def _signatures(bands: int, rows: int, k: int):
    permutations = (bands * rows + 1) // 2
    place = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(it):
        for b, data, bounds in batches(it):
            low = LOWER[data]
            words = Words(low, bounds)
            h, at = words.windows(words.hashes(), k)
            doc = words.doc[at]
            n = b.num_rows
            cut = np.searchsorted(doc, np.arange(n + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            values = signature_values(h, cut[full], permutations)
            keys = np.zeros((full.size, bands), np.uint64)
            for r in range(rows):
                keys = keys * np.uint64(0x9E3779B97F4A7C15) + mix(values[:, r : bands * rows : rows])
            keys = mix(keys + place).view(np.int64)
            size = np.diff(words.first)
            counts = np.where((size > 0) & (size < k), 1, 0)
            for d in full.tolist():
                s = np.sort(h[cut[d] : cut[d + 1]])
                counts[d] = 1 + int((s[1:] != s[:-1]).sum())
            raw, ends = low.tobytes(), bounds.tolist()
            sequences = [hashlib.blake2b(b" ".join(raw[i:j].split()), digest_size=16).digest() if m else None for i, j, m in zip(ends, ends[1:], size.tolist())]
            band_rows = [None] * n
            for i, d in enumerate(full.tolist()):
                band_rows[d] = keys[i]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sequences, pa.binary()), pa.array(band_rows, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "sequence", "bands"],
            )

    return run


def shingles(text: bytes, k: int = SHINGLE) -> set:
    words = text.lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def _confirm(percent: int, k: int):
    def run(it):
        held: OrderedDict = OrderedDict()

        def of(i: int, text: str) -> set:
            key = (i, len(text), hash(text))
            s = held.pop(key, None)
            if s is None:
                s = shingles(text.encode(), k)
            held[key] = s
            if len(held) > 16:
                held.popitem(last=False)
            return s

        for batch in it:
            out: list[list[int]] = [[], []]
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                s, t = of(a, x), of(b, y)
                both = len(s & t)
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(thrifty(_confirm(percent, k)), "a long, b long")


def _shingle_hashes(k: int, seed: int):
    def run(it):
        for b, data, bounds in batches(it):
            words = Words(LOWER[data], bounds)
            h, at = words.windows(words.hashes(seed), k)
            cut = np.searchsorted(words.doc[at], np.arange(b.num_rows + 1)).tolist()
            sets = [np.unique(h[i:j]).view(np.int64) for i, j in zip(cut, cut[1:])]
            keys = [int(mix(x.view(np.uint64)).sum()) - (1 << 63) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("comp"), pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "comp", "key", "shingles"])

    return run


def _shared_sets(loose: DataFrame, texts: DataFrame, percent: int, k: int, seed: int) -> DataFrame:
    """SETS of the loose documents' texts: n, its size; rare, of its rarest shingles those that other texts have, as many as a linked set may lack and one more; shingles, all that other texts have."""
    rows = loose.join(texts.withColumnRenamed("doc_id", "doc"), "doc").mapInArrow(thrifty(_shingle_hashes(k, seed)), "doc long, comp long, key long, shingles array<long>")
    every = rows.select("doc", "comp", "key", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    # A table of its own, so that a shingle in very many documents can be split in the join.
    known = stored(every.groupBy("shingle").agg(F.count("*").alias("docs")).where("docs > 1"), "known")
    shared = every.join(known, "shingle").groupBy("doc", "key", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("docs", "shingle"))).alias("s"))
    # The set's own shingles are rarer than all others, and there are n - size(s) of them.
    rare = f"slice(s, 1, greatest(0, size(s) - cast(ceil(n * {percent} / 100) as int) + 1)).shingle"
    out = stored(shared.select("doc", "comp", "key", "n", F.expr(rare).alias("rare"), F.col("s.shingle").alias("shingles")).where("size(rare) > 0"), "sets")
    release(known)
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The number of values that each two of the sets have in common."""
    n = len(sets)
    out = np.zeros(n * n)
    owner = np.repeat(np.arange(n), [x.size for x in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if value.size else np.zeros(0, np.int64)
    length = np.diff(np.append(first, value.size))
    for size in np.unique(length[(length > 1) & (length <= COMMON)]).tolist():
        at = first[length == size]
        step = max(1, (1 << 22) // size**2)
        for i in range(0, at.size, step):
            lists = owner[at[i : i + step, None] + np.arange(size)]
            out += np.bincount((lists[:, :, None] * n + lists[:, None, :]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    common = np.flatnonzero(length > COMMON)
    for i in range(0, common.size, 4096):
        block = common[i : i + 4096]
        has = np.zeros((n, block.size), np.float32)
        for c, (a, m) in enumerate(zip(first[block].tolist(), length[block].tolist())):
            has[owner[a : a + m], c] = 1
        out += has @ has.T
    return out


def forest(linked: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of the matrix that join its rows' components, none of them in vain."""
    own = np.unique(comp, return_inverse=True)[1]
    reached, edges = np.zeros(own.max(initial=-1) + 1, bool), []
    for start in range(comp.size):
        if reached[own[start]]:
            continue
        reached[own[start]] = True
        front = np.flatnonzero(own == own[start])
        while front.size:
            meets = linked[front]
            new = np.flatnonzero(meets.any(0) & ~reached[own])
            _, once = np.unique(own[new], return_index=True)
            new = new[once]
            edges += zip(front[meets[:, new].argmax(0)].tolist(), new.tolist())
            reached[own[new]] = True
            front = np.flatnonzero(np.isin(own, own[new])) if new.size else new
    return edges


def _tile_links(percent: int):
    """Links between components of the sets of two tiles of a band, or of one."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("doc").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        doc, comp, tile, n = (group.column(c).to_numpy() for c in ("doc", "comp", "tile", "n"))
        both = intersections([np.asarray(x, np.int64) for x in group.column("shingles").to_numpy()])
        linked = 100 * both >= percent * (n[:, None].astype(np.int64) + n[None, :] - both)
        linked &= comp[:, None] != comp[None, :]
        if group.column("low")[0].as_py() != group.column("high")[0].as_py():
            linked &= tile[:, None] != tile[None, :]
        edges = forest(linked, comp)
        del both, linked
        if n.size > TILE_DOCS // 4:
            give_back()
        return pa.table({"a": pa.array([int(doc[i]) for i, _ in edges], pa.int64()), "b": pa.array([int(doc[j]) for _, j in edges], pa.int64())})

    return run


def _loose_links(state: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Confirmed links that join the components of documents in open bands."""
    open_bands = state.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("docs").alias("size")).where("lo <> hi and size > 2").select("band")
    loose = stored(state.select("band", "doc", "comp").join(open_bands, "band"), "loose")
    seed = 0
    while True:
        sets = _shared_sets(loose.select("doc", "comp").distinct(), texts, percent, k, seed)
        rare = sets.select("doc", "comp", F.explode("rare").alias("shingle"))
        mixed = stored(rare.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle"), "mixed")
        active = stored(rare.join(mixed, "shingle", "left_semi").select("doc").distinct(), "active")
        met = loose.join(active, "doc", "left_semi").join(sets.select("doc", "key", F.size("shingles").alias("m")), "doc")
        bands = met.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("docs"), F.sum("m").alias("all")).where("lo <> hi")
        tiles = stored(bands.select("band", F.ceil(F.greatest(F.col("docs") / TILE_DOCS, F.col("all") / TILE_SHINGLES)).cast("int").alias("tiles")), "tiles")
        places = (
            met.join(tiles, "band")
            .withColumn("tile", F.pmod(F.xxhash64("doc", "key"), F.col("tiles")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("band", "doc", "key", "tile", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"))
        )
        laid = places.join(sets.drop("rare"), ["doc", "key"]).select("band", "low", "high", "tile", "doc", "comp", "n", "shingles")
        found = stored(laid.groupBy("band", "low", "high").applyInArrow(_tile_links(percent), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "found")
        links = stored(confirmed(found, texts, percent, k), "links")
        whole = found.count() == links.select("a", "b").distinct().count()
        release(sets, mixed, active, tiles, found)
        if whole:
            release(loose)
            return links
        release(links)
        seed += 1


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp) of every end of the edges (a, b), as a stored table; comp is the smallest document reachable."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    mark = None
    while True:
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark or not got[0]:
            break
        mark = got
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(before)
    out = stored(e.select(F.col("u").alias("doc"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("doc"), F.col("v").alias("comp")).distinct()), "components")
    release(e)
    return out


def dedup(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(named.mapInArrow(thrifty(_signatures(bands_for(percent, rows, miss), rows, k)), SIGNATURES), "signatures")

    # Tables of their own below, so that a hot sequence or band can be split in the joins.
    classes = stored(signed.where("doc_id is not null and sequence is not null").groupBy("sequence").agg(F.min("doc_id").alias("rep")), "sequences")
    placed = stored(signed.select("doc_id", "n_shingles", "sequence").join(classes, "sequence", "left").select("doc_id", "n_shingles", "rep"), "classes")
    # A doc_id with several texts belongs to several classes, which it links.
    spread = placed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    joint = stored(spread.join(placed, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")), "joint")

    stand = signed.where("bands is not null").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "sequence"], "left_semi")
    dealt = stand.select(F.explode("bands").alias("band"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    buckets = stored(dealt.groupBy("band").agg(F.min(F.struct("doc", "n")).alias("hub"), F.count("*").alias("docs")).where("docs > 1"), "bands")
    members = stored(
        dealt.join(buckets, "band").select("band", "doc", "n", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n"), "docs"), "members"
    )
    release(signed, classes, buckets)
    fits = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    pairs = members.where("doc <> hub").where(fits).select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    texts = stored(named.join(members.select(F.col("doc").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    first = stored(confirmed(pairs, texts, percent, k).unionByName(joint), "links")

    comp = components(first)
    state = stored(members.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")), "state")
    release(members, joint, comp)
    more = _loose_links(state, texts, percent, k)
    final = components(first.unionByName(more))
    release(first, more, state, texts)
    return (
        placed.join(final.withColumnRenamed("doc", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: of each component those of its smallest doc_id."""
    kept = dedup(docs, percent).where("kept").select("doc_id").distinct()
    a, b = docs.alias("a"), kept.alias("b")
    return a.join(b, F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")), "left_semi")
