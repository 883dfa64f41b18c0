"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits of the lowered text. A mask names the
positions of a span of words that count; the others are ignored. The hashes
of all masked spans of documents and of benchmark items are joined, which
finds overlaps in spite of replaced words. Around each hit the document and
the item are laid over each other at the hit's offset: a document is
contaminated where WINDOW words in a row (or all of a shorter item) agree in
at least PERCENT of their positions. MASKS hit every window of 13 words with
up to two replaced words, which are all windows that reach the threshold. An
item of fewer words has masks of its own length, which leave out each choice
of as many parts of it as words may differ; documents are masked in the
lengths that occur among the items, at most WINDOW - 1 of them.

The items' hashes are broadcast if counts show them to be at most
BROADCAST_SEEDS rows (and items at most BROADCAST_ITEMS bytes), the ids of
documents that were hit if they are at most BROADCAST_DOCS; otherwise these
joins are shuffled.

Cases: null text has no words; an item without words matches nothing, one of
up to four words matches where all of them are; each row is judged by its own
text, rows that share a doc_id too; repeated items count once each; a null
doc_id is judged like any other value; other columns are ignored; empty
tables give no rows, or no contamination.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stored

#: Counted positions of each mask for items of WINDOW words and more; both span nine words.
MASKS = ((0, 1, 2, 5, 6, 8), (0, 1, 3, 6, 7, 8))
WINDOW = 13
PERCENT = 80
BROADCAST_SEEDS = 1_000_000
BROADCAST_ITEMS = 32 << 20
BROADCAST_DOCS = 1_000_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(length: int, percent: int = PERCENT) -> tuple[tuple[int, ...], ...]:
    """Masks of a whole item of so many words: wherever the words that may differ are, one mask doesn't count them."""
    differ = length - -(-length * percent // 100)
    if not differ:
        return (tuple(range(length)),)
    parts = min(length, differ + 2)
    cuts = [length * k // parts for k in range(parts + 1)]
    return tuple(tuple(p for k in range(parts) if k not in out for p in range(cuts[k], cuts[k + 1])) for out in combinations(range(parts), differ))


def _masked(length: int, masks) -> str:
    """SQL: the seeds of all spans of so many words of h, mask after mask."""
    hashes = [f"transform(sequence(0, size(h) - {length}), i -> xxhash64({', '.join(f'h[i + {p}]' for p in m)}, {1000 * length + k}))" for k, m in enumerate(masks)]
    return f"if(size(h) >= {length}, concat({', '.join(hashes)}), cast(array() as array<bigint>))"


def seeds(rows: DataFrame, keys: list[str], lengths: list[int], masks=MASKS, percent: int = PERCENT) -> DataFrame:
    """(keys, at, seed): the masked hashes of each row; at is the span's first word.

    rows has the keys and h, the hashes of its words. lengths: of the short
    items that are looked for; WINDOW stands for all others.
    """
    of = [(max(map(max, masks)) + 1, masks) if n == WINDOW else (n, short_masks(n, percent)) for n in lengths]
    # Which length and which mask a seed belongs to follows from its place.
    at, before = "", "0"
    for n, m in of:
        spans = f"greatest(0, words - {n - 1})"
        at += f" when place < {before} + {len(m)} * {spans} then (place - ({before})) % {spans}"
        before += f" + {len(m)} * {spans}"
    return (
        rows.select(*keys, F.size("h").alias("words"), F.expr(f"concat({', '.join(_masked(n, m) for n, m in of)})").alias("all"))
        .select(*keys, "words", F.posexplode_outer("all").alias("place", "seed"))  # the plain form would test the array's size before, and compute it twice
        .where("seed is not null")
        .select(*keys, F.expr(f"case{at} end").alias("at"), "seed")
    )


def _agreement(window: int) -> Column:
    """Where an overlay's part of the document agrees with the item; null if the overlay is shorter than a window."""
    same = F.transform(F.sequence(F.lit(0), F.size("part") - 1), lambda j: (F.col("item")[j + F.col("low")] == F.col("part")[j]).cast("int"))
    return F.when(F.size("part") >= F.least(F.lit(window), F.size("item")), same)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the text; both name what a row says) and text."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("print"), F.col("text").alias("text"))


SAME = "a.doc_id <=> b.doc_id and a.print = b.print"


def matches(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """(doc_id, print, item_id, n_overlaps, best_percent): the items that a document holds, as a stored table."""
    rows = _rows(docs)
    items = benchmark.select(F.col("item_id"), word_hashes(F.col("text")).alias("h")).where("size(h) > 0")
    # A row for each length, so at most `window` of them.
    lengths = items.groupBy(F.least(F.size("h"), F.lit(window)).alias("n")).agg(F.count("*").alias("items"), F.sum(F.size("h").cast("long")).alias("words")).orderBy("n").collect()
    if not lengths:
        return rows.where("false").select("doc_id", "print", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_overlaps"), F.lit(0.0).alias("best_percent"))
    of_item = None
    for r in lengths:
        own = seeds(items.where(F.least(F.size("h"), F.lit(window)) == r["n"]).withColumn("length", F.size("h")), ["item_id", "length"], [r["n"]], masks, percent)
        of_item = own if of_item is None else of_item.unionByName(own)
    of_item = of_item.withColumnRenamed("at", "item_at")
    most = sum(r["words"] * (len(masks) if r["n"] == window else len(short_masks(r["n"], percent))) for r in lengths)
    small = most <= BROADCAST_SEEDS and 8 * sum(r["words"] for r in lengths) <= BROADCAST_ITEMS
    hint = F.broadcast if small else (lambda x: x)

    # (row, item, shift, words of the item): a table, so that the texts are masked once.
    hits = stored(
        seeds(rows.select("doc_id", "print", word_hashes(F.col("text")).alias("h")), ["doc_id", "print"], [r["n"] for r in lengths], masks, percent)
        .join(hint(of_item), "seed")
        .select("doc_id", "print", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "length")
        .distinct(),
        "hits",
    )
    per_row = hits.groupBy("doc_id", "print").agg(F.collect_list(F.struct("item_id", "shift", "length")).alias("hits"))
    hit = hits.select("doc_id", "print").distinct()
    near = F.broadcast if hit.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else (lambda x: x)
    # Texts that nothing hit go no further than this, and equal rows are one.
    texts = rows.alias("a").join(near(hit.alias("b")), F.expr(SAME), "left_semi").select("a.*").dropDuplicates(["doc_id", "print"])
    # Of each hit only the words under the item go on.
    part = "slice(h, greatest(x.shift, 0) + 1, least(x.length, size(h) - x.shift) + least(x.shift, 0))"
    laid = (
        texts.alias("a")
        .join(per_row.alias("b"), F.expr(SAME))
        .select("a.doc_id", "a.print", word_hashes(F.col("a.text")).alias("h"), "hits")
        .select("doc_id", "print", F.explode(F.expr(f"transform(hits, x -> struct(x.item_id, greatest(-x.shift, 0) as low, {part} as part))")).alias("x"))
        .select("doc_id", "print", "x.*")
    )
    overlay = laid.join(hint(items.select("item_id", F.col("h").alias("item"))), "item_id").select(
        "doc_id", "print", "item_id", F.least(F.lit(window), F.size("item")).alias("w"), _agreement(window).alias("same")
    )
    scored = overlay.where("same is not null").select(
        "doc_id", "print", "item_id", "w",
        F.expr("array_max(transform(sequence(0, size(same) - w), i -> aggregate(slice(same, i + 1, w), 0, (s, x) -> s + x)))").alias("best"),
    )
    # Filtered after the sum, since a filter on an expression makes Spark compute it twice.
    return stored(
        scored.groupBy("doc_id", "print", "item_id")
        .agg(F.sum((F.col("best") * 100 >= F.col("w") * percent).cast("long")).alias("n_overlaps"), F.max(F.col("best") * 100.0 / F.col("w")).alias("best_percent"))
        .where("n_overlaps > 0"),
        "matches",
    )


def _bounded(found: DataFrame) -> DataFrame:
    return F.broadcast(found) if found.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else found


def flagged(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, item_ids, best_percent."""
    found = matches(docs, benchmark, **how).groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("best_percent").alias("best_percent"))
    a, b = _rows(docs).select("doc_id", "print").alias("a"), _bounded(found).alias("b")
    return a.join(b, F.expr(SAME), "left").select(
        F.col("a.doc_id").alias("doc_id"), F.col("item_ids").isNotNull().alias("contaminated"), "item_ids", "best_percent"
    )


def keep(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no benchmark item, with the columns of docs."""
    found = _bounded(matches(docs, benchmark, **how).select("doc_id", "print").distinct()).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.text") == F.col("b.print"))
    return docs.alias("a").join(found, same, "left_anti")
