"""Private Flajolet-Martin sketches of value sets, and counts across parties from them.

For each seed a row's key hashes to a geometric level. A sketch of (attribute,
value) holds the largest level of all rows with another value (the
complement). By De Morgan the rows with value x here and y there are n less
the union of the two complements, whose sketch is the larger of the two
levels. Sketches combine by maximum, so partial aggregation does most of the
work and parties, partitions and micro-batches merge alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.hashing import TWO32, geometric_level, hash32, uniform


@dataclass(frozen=True)
class Privacy:
    """k phantom rows and a least level for each sketch; both 0 without privacy."""

    phantoms: int = 0
    floor: int = 0


def privacy(epsilon: float, delta: float, m: int, gamma: float) -> Privacy:
    if not (epsilon > 0 and 0 < delta < 1):
        return Privacy()
    each = epsilon / 4 / math.sqrt(m * math.log(1 / delta))
    return Privacy(math.ceil(1 / math.expm1(each)), math.ceil(-math.log(-math.expm1(-each)) / math.log1p(gamma)))


def bias(m: int) -> float:
    """The factor of the harmonic estimate."""
    return 0.7213 / (1 + 1.079 / m)


def seeds(spark: SparkSession, m: int) -> DataFrame:
    return spark.range(m).select(F.col("id").cast("int").alias("seed"))


def levels(rows: DataFrame, key: str, m: int, gamma: float = 1.0) -> DataFrame:
    """rows with seed and level, one row for each seed; each key is hashed once a seed."""
    each = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return each.withColumn("level", geometric_level(hash32(F.col("seed"), F.col(key)), gamma))


def value_sketches(rows: DataFrame, key: str, attributes: list[str], m: int, gamma: float = 1.0) -> DataFrame:
    """(seed, attr, value, level): the largest level of the rows with each value."""
    each = levels(rows.select(key, *attributes), key, m, gamma)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attributes]))
    return each.select("seed", "level", pairs.alias("p")).groupBy("seed", "p.attr", "p.value").agg(F.max("level").alias("level"))


def complements(sketches: DataFrame) -> DataFrame:
    """(seed, attr, value, alpha): the largest level over the other values; 0 if there are none.

    The two largest levels of an attribute decide all of its complements.
    """
    w = Window.partitionBy("seed", "attr")
    top = F.max(F.struct("level", "value")).over(w)
    second = F.max("level").over(w.orderBy(F.desc("level"), F.desc("value")).rowsBetween(1, Window.unboundedFollowing))
    ranked = sketches.select("seed", "attr", "value", "level", top.alias("top"), second.alias("after"))
    rest = F.max("after").over(w.orderBy(F.desc("level"), F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.select("seed", "attr", "value", F.coalesce(F.when(F.col("value") == F.col("top.value"), rest).otherwise(F.col("top.level")), F.lit(0)).alias("alpha"))


def privatize(sketches: DataFrame, p: Privacy, gamma: float, noise_seed: int) -> DataFrame:
    """The larger of each level, the floor, and the largest of the phantoms' levels, drawn at once by its inverse distribution."""
    if not p.phantoms:
        return sketches
    u = uniform(F.lit(noise_seed), F.col("seed"), F.col("attr"), F.col("value"))
    log_q = math.log(1 - gamma / (1 + gamma))
    # P(max <= x) = (1 - q^x)^k
    drawn = F.ceil(F.log(-F.expm1(F.log(u) / F.lit(float(p.phantoms)))) / F.lit(log_q)).cast("int")
    return sketches.withColumn("alpha", F.greatest(F.col("alpha"), drawn, F.lit(p.floor)))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """(attr_a, value_a, attr_b, value_b, seed, alpha): the sketch of the union of each pair of sets, joined by seed."""
    a = left.select("seed", F.col("attr").alias("attr_a"), F.col("value").alias("value_a"), F.col("alpha").alias("x"))
    b = right.select("seed", F.col("attr").alias("attr_b"), F.col("value").alias("value_b"), F.col("alpha").alias("y"))
    return a.join(b, "seed").select("attr_a", "value_a", "attr_b", "value_b", "seed", F.greatest("x", "y").alias("alpha"))


def estimate(alpha: Column, m: int, gamma: float = 1.0) -> Column:
    """The harmonic estimate of a set's size over its m levels; an aggregate."""
    return F.lit(float(m) * bias(m)) / F.sum(F.pow(F.lit(1.0 + gamma), -alpha.cast("double")))


def intersections(left: DataFrame, right: DataFrame, n: int, m: int, gamma: float = 1.0, p: Privacy = Privacy(), least: float = 10.0) -> DataFrame:
    """(attr_a, value_a, attr_b, value_b, value): the estimated joint counts, scaled to n.

    Each sketch of a value holds the phantoms of the other values: for two
    attributes of d_a and d_b values, (d_a - 1) + (d_b - 1) lots, which the
    estimate of the union is relieved of. Negative counts become `least`.
    """
    cells = union(left, right).groupBy("attr_a", "value_a", "attr_b", "value_b").agg(estimate(F.col("alpha"), m, gamma).alias("union"))
    pair = Window.partitionBy("attr_a", "attr_b")
    d = F.size(F.collect_set("value_a").over(pair)) + F.size(F.collect_set("value_b").over(pair)) - 2
    raw = F.lit(float(n)) - (F.col("union") - F.lit(float(p.phantoms)) * d)
    kept = cells.withColumn("raw", F.when(raw < 0, F.lit(float(least))).otherwise(raw))
    return kept.select("attr_a", "value_a", "attr_b", "value_b", (F.col("raw") * F.lit(float(n)) / F.sum("raw").over(pair)).alias("value"))


def histogram(sketches: DataFrame, n: int, m: int, gamma: float = 1.0, p: Privacy = Privacy()) -> DataFrame:
    """(attr, value, count): one attribute's counts from its complements, clamped at 0 and scaled to n."""
    per = sketches.groupBy("attr", "value").agg(estimate(F.col("alpha"), m, gamma).alias("other"))
    w = Window.partitionBy("attr")
    d = F.count("*").over(w) - 1
    raw = per.withColumn("raw", F.greatest(F.lit(0.0), F.lit(float(n)) - (F.col("other") - F.lit(float(p.phantoms)) * d)))
    return raw.select("attr", "value", F.when(F.sum("raw").over(w) > 0, F.col("raw") * F.lit(float(n)) / F.sum("raw").over(w)).otherwise(0.0).alias("count"))


#: Hashes reach up to this number.
HASH_RANGE = TWO32
