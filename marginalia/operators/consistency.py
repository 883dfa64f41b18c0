"""Marginals from different sources made to agree on the attributes that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def agree(cells: DataFrame, attribute: str, source: str = "source", value: str = "value") -> DataFrame:
    """cells of all sources with one attribute's marginal averaged over sources; each source spreads its difference evenly over its cells."""
    own = F.sum(value).over(Window.partitionBy(source, attribute))
    count = F.count("*").over(Window.partitionBy(source, attribute))
    with_own = cells.withColumn("__own", own).withColumn("__count", count)
    # Each source's marginal counts once, however many cells it has.
    mean = F.sum(F.col("__own") / F.col("__count")).over(Window.partitionBy(attribute)) / F.sum(F.lit(1.0) / F.col("__count")).over(Window.partitionBy(attribute))
    return with_own.withColumn(value, F.col(value) + (mean - F.col("__own")) / F.col("__count")).drop("__own", "__count")


def rescale(cells: DataFrame, n: float, source: str = "source", value: str = "value") -> DataFrame:
    low = F.greatest(F.lit(0.0), F.col(value))
    total = F.sum(low).over(Window.partitionBy(source))
    return cells.withColumn(value, F.when(total > 0, low * F.lit(float(n)) / total).otherwise(0.0))


def enforce(tables: dict[str, DataFrame], n: float, rounds: int = 4) -> dict[str, DataFrame]:
    """Several two-way (or wider) marginals after `rounds` rounds over all shared attributes.

    A shared attribute's cells of all tables are laid together for its turn.
    """
    from marginalia.sources.tables import cut

    out = dict(tables)
    axes = {k: [c for c in t.columns if c != "value"] for k, t in out.items()}
    shared = sorted(a for a in {a for x in axes.values() for a in x} if sum(a in x for x in axes.values()) > 1)
    for _ in range(rounds):
        for a in shared:
            using = [k for k in out if a in axes[k]]
            laid = None
            for k in using:
                rest = [c for c in axes[k] if c != a]
                part = out[k].select(F.lit(k).alias("source"), F.col(a).cast("string").alias("at"), F.to_json(F.struct(*rest)).alias("rest"), F.struct(*axes[k]).cast("string").alias("cell"), F.col("value").cast("double").alias("value"))
                laid = part if laid is None else laid.unionByName(part)
            moved = cut(agree(laid, "at"))
            for k in using:
                mine = moved.where(F.col("source") == k).select("cell", "value")
                out[k] = out[k].withColumn("cell", F.struct(*axes[k]).cast("string")).drop("value").join(mine, "cell").select(*axes[k], "value")
        out = {k: cut(rescale(t.withColumn("source", F.lit(k)), n).drop("source")) for k, t in out.items()}
    return out
