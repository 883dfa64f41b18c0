"""Row sets, sets of attributes, measures and messages as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.hashing import hash32, uniform
from marginalia.operators.order import numbered


def membership(df: DataFrame, column: str, key: str) -> DataFrame:
    """(value, key): the inverted index of a column in long form, so that no value's rows gather in one cell."""
    return df.select(F.col(column).alias("value"), F.col(key).alias("row_id")).where("value is not null")


def intersections(parties: list[DataFrame], columns: list[str], key: str) -> DataFrame:
    """Exact joint counts of columns held by different parties: rows joined by key, then counted."""
    out = parties[0].select(key, columns[0])
    for p, c in zip(parties[1:], columns[1:]):
        out = out.join(p.select(key, c), key)
    return out.groupBy(*columns).agg(F.count("*").alias("value"))


def split_parties(df: DataFrame, key: str, sides: list[list[str]]) -> list[DataFrame]:
    return [df.select(key, *cols) for cols in sides]


def contained(measure, other):
    """Whether the first array of attributes is a subset of the second."""
    return F.size(F.array_except(measure, other)) == 0


def maximal(measures: DataFrame) -> DataFrame:
    """The measures that no other contains; equal sets once. Measures are metadata, a few thousand rows."""
    sets = measures.select(F.array_sort("measure").alias("measure")).distinct()
    a, b = sets.alias("a"), sets.select(F.col("measure").alias("larger")).alias("b")
    # Meets on one attribute first, so that it is an equi-join.
    a1 = a.select("measure", F.explode("measure").alias("x"))
    b1 = b.select("larger", F.explode("larger").alias("x"))
    inside = a1.join(b1, "x").where((F.size("larger") > F.size("measure")) & contained(F.col("measure"), F.col("larger"))).select("measure").distinct()
    return sets.join(inside, "measure", "left_anti")


def cross_only(measures: DataFrame, side_a: list[str], side_b: list[str], most: int = 2) -> DataFrame:
    """Measures with attributes of both parties and at most `most` of them."""
    a, b = F.array(*map(F.lit, side_a)), F.array(*map(F.lit, side_b))
    return measures.where(F.arrays_overlap("measure", a) & F.arrays_overlap("measure", b) & (F.size("measure") <= most))


def merge_weights(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("measure").agg(F.sum("weight").alias("weight"))


def top(scored: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


def top_late(scored: DataFrame, score: str, key: str, k: int, round_of: str, share: float = 0.5) -> DataFrame:
    """The k best where a candidate that came in round r (from 0) counts share ** r of its score, so that late ones need to be better."""
    weighed = scored.withColumn("weighed", F.col(score) * F.pow(F.lit(float(share)), F.col(round_of)))
    return top(weighed, "weighed", key, k)


def length_histogram(measures: DataFrame) -> DataFrame:
    return measures.groupBy(F.size("measure").alias("length")).agg(F.count("*").alias("n"))


def assign(measures: DataFrame, cliques: DataFrame) -> DataFrame:
    """(measure, clique_id): the first clique that contains each measure; cliques have clique_id and clique."""
    m = measures.select("measure", F.explode("measure").alias("x"))
    c = cliques.select("clique_id", "clique", F.explode("clique").alias("x"))
    return m.join(c, "x").where(contained(F.col("measure"), F.col("clique"))).groupBy("measure").agg(F.min("clique_id").alias("clique_id"))


def message_dependencies(edges: DataFrame) -> DataFrame:
    """Of messages along both ways of the edges (a, b): (src, dst) waits for (needs_src, src), if that isn't its own reverse."""
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    before = both.select(F.col("src").alias("needs_src"), F.col("dst").alias("via"))
    return both.join(before, F.col("src") == F.col("via")).where("needs_src <> dst").select("src", "dst", "needs_src")


# Rows: order, splits and samples by hash


def hash_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with `position`, the row's place in an order that depends on seed and key alone."""
    return numbered(df, [hash32(F.lit(seed), F.col(key)), F.col(key)], "position")


def split(df: DataFrame, key: str, seed: int, share: float = 0.8) -> DataFrame:
    """df with `train`: by the key's hash, so no row needs to know of others."""
    return df.withColumn("train", uniform(F.lit(seed), F.col(key)) < F.lit(share))


def folds(df: DataFrame, key: str, seed: int, k: int = 5) -> DataFrame:
    """df with `fold`: slices of equal size of the hashed order."""
    n = df.count()
    return hash_order(df, key, seed).withColumn("fold", F.floor(F.col("position") * F.lit(k) / F.lit(n)).cast("int")).drop("position")


def weighted_sample(items: DataFrame, weight: str, key: str, k: int, seed: int) -> DataFrame:
    """k draws with replacement, then distinct: cumulative weights joined with k uniforms by range.

    For metadata tables (candidate measures); one order over all items.
    """
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(weight).over(Window.partitionBy())
    cum = items.withColumn("hi", F.sum(weight).over(w) / total).withColumn("lo", F.col("hi") - F.col(weight) / total)
    draws = items.sparkSession.range(k).select(uniform(F.lit(seed), F.col("id")).alias("u"))
    return cum.join(F.broadcast(draws), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).drop("u", "lo", "hi").distinct()


def row_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(hash32(F.lit(seed), F.col(key)), key).limit(n)


# Results


def latest(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same keys the last one: an upsert over appended results."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return results.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def average(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("repeats"))
