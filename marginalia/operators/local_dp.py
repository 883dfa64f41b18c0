"""Randomized response and local hashing, and unbiased counts from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.hashing import hash32, uniform


def rates(epsilon: float, d: int) -> tuple[float, float]:
    """(p, q): the chance to keep a code, and that of each other code."""
    e = math.exp(epsilon)
    return e / (e + d - 1), 1 / (e + d - 1)


def perturb(code: Column, epsilon: float, d: int, *key: Column) -> Column:
    """Keep with chance p - q, else a uniform code of the whole domain; both draws depend on the key alone."""
    p, q = rates(epsilon, d)
    other = F.floor(uniform(*key, F.lit("other")) * F.lit(float(d))).cast("int")
    return F.when(uniform(*key, F.lit("keep")) < F.lit(p - q), code.cast("int")).otherwise(other)


def perturb_columns(df: DataFrame, sizes: dict[str, int], epsilon: float, key: str, seed: int) -> DataFrame:
    """key and the perturbed columns, each with a seed of its own."""
    return df.select(key, *[perturb(F.col(c), epsilon, d, F.lit(f"{seed}:{c}"), F.col(key)).alias(c) for c, d in sizes.items()])


def unbias(cells: DataFrame, sizes: dict[str, int], epsilon: float, value: str = "value") -> DataFrame:
    """The dense table of perturbed codes with the perturbation taken back, axis by axis.

    Along one axis the transition is (p - q) I + q J, whose inverse needs the
    sums along the axis alone; over several axes it is their product. So no
    matrix of cells by cells is made.
    """
    out = cells.withColumn(value, F.col(value).cast("double"))
    for c, d in sizes.items():
        p, q = rates(epsilon, d)
        others = [x for x in sizes if x != c]
        along = F.sum(value).over(Window.partitionBy(*others))
        out = out.withColumn(value, (F.col(value) - F.lit(q / (p - q + d * q)) * along) / F.lit(p - q))
    return out


def clamp_and_scale(cells: DataFrame, n: float, value: str = "value") -> DataFrame:
    """Negative cells to 0, then the sum to n."""
    low = F.greatest(F.lit(0.0), F.col(value))
    total = F.sum(low).over(Window.partitionBy())
    return cells.withColumn(value, F.when(total > 0, low * F.lit(float(n)) / total).otherwise(0.0))


def hash_range(epsilon: float) -> int:
    return round(math.exp(epsilon)) + 1


def local_hash(value: Column, key: Column, g: int) -> Column:
    """The value's hash under the row's own hash function."""
    return F.pmod(hash32(key, value), F.lit(g)).cast("int")


def hash_perturb(df: DataFrame, column: str, epsilon: float, key: str, seed: int) -> DataFrame:
    """(key, report): the value's hash, kept or replaced by randomized response over the range."""
    g = hash_range(epsilon)
    h = local_hash(F.col(column), F.col(key), g)
    return df.select(key, perturb(h, epsilon, g, F.lit(f"{seed}:lh"), F.col(key)).alias("report"))


def support(reports: DataFrame, key: str, d: int, epsilon: float) -> DataFrame:
    """(value, support, estimate): how many rows' reports agree with each value, and the unbiased count."""
    g = hash_range(epsilon)
    p = math.exp(epsilon) / (math.exp(epsilon) + g - 1)
    each = reports.withColumn("value", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    agree = (local_hash(F.col("value"), F.col(key), g) == F.col("report")).cast("long")
    return each.groupBy("value").agg(F.sum(agree).alias("support"), F.count("*").alias("n")).select(
        "value", "support", ((F.col("support") - F.col("n") / F.lit(float(g))) / F.lit(p - 1.0 / g)).alias("estimate")
    )
