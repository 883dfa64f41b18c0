"""Places in one order over all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows one task numbers them at once.
FEW_ROWS = 200_000
#: Rows of one partition come after its number in this many bits.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str, few: int = FEW_ROWS) -> DataFrame:
    """df with its rows' places (from 0) in this order, which has no ties.

    Many rows are dealt out by ranges of the order, numbered within each
    partition and stored; a place is that number and the size of all
    partitions before, which is a row for each partition.
    """
    from marginalia.sources.tables import cut

    if df.limit(few + 1).count() <= few:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    keys = [f"__order{k}" for k in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = cut(ranged.drop(*keys).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", ROW_BITS).cast("int")
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = sizes.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return held.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__id", "__before")
