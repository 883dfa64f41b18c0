"""Tables drawn from a model: counts by largest remainder, column by column down the junction tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.hashing import hash32
from marginalia.operators.encode import BROADCAST_ROWS, small
from marginalia.operators.mrf import Model, Table

#: Rows of a block that one task numbers, about.
BLOCK_ROWS = 1 << 17


def allocate(probabilities: DataFrame, totals, groups: list[str], value: str = "value", prob: str = "prob") -> DataFrame:
    """groups, value and count: whole parts of prob * total, and one more for the largest remainders, in each group.

    totals is a column. Probabilities are scaled to 1; where all are 0 they are equal. Ties go to the smaller value.
    """
    w = Window.partitionBy(*groups)
    mass = F.sum(prob).over(w)
    p = F.when(mass > 0, F.col(prob) / mass).otherwise(F.lit(1.0) / F.count("*").over(w))
    share = probabilities.withColumn("__p", p).withColumn("__t", totals.cast("double"))
    # Rounded first, so that both engines of a comparison see the same remainders.
    share = share.withColumn("__x", F.round(F.col("__p") * F.col("__t"), 9)).withColumn("__whole", F.floor("__x").cast("long"))
    share = share.withColumn("__rest", F.round(F.col("__x") - F.col("__whole"), 9)).withColumn("__left", F.col("__t").cast("long") - F.sum("__whole").over(w))
    rank = F.row_number().over(w.orderBy(F.desc("__rest"), value))
    return share.select(*groups, value, (F.col("__whole") + (rank <= F.col("__left")).cast("long")).alias("count"))


def spread(counts: DataFrame, groups: list[str], value: str = "value") -> DataFrame:
    """groups, value, lo and hi: each value's range of row numbers in its group, from 0."""
    w = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.sum("count").over(w)
    return counts.select(*groups, value, (hi - F.col("count")).alias("lo"), hi.alias("hi"))


def numbered_in_groups(rows: DataFrame, key: str, groups: list[str], salt: str, n: int) -> DataFrame:
    """rows with `__row`, the place (from 0) in a hashed order of its group.

    The order is by blocks of about BLOCK_ROWS rows, dealt by the key's hash,
    and by another hash within a block, so a group of any size is spread over
    many tasks; a block's first place is the size of the group's blocks before.
    """
    blocks = max(1, -(-n // BLOCK_ROWS))
    block = F.pmod(hash32(F.lit(f"{salt}:block"), F.col(key)), F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0)
    dealt = rows.withColumn("__block", block)
    within = F.row_number().over(Window.partitionBy(*groups, "__block").orderBy(hash32(F.lit(salt), F.col(key)), key)) - 1
    placed = dealt.withColumn("__row", within.cast("long"))
    if blocks == 1:
        return placed.drop("__block")
    sizes = dealt.groupBy(*groups, "__block").agg(F.count("*").alias("__size"))
    first = F.sum("__size").over(Window.partitionBy(*groups).orderBy("__block")) - F.col("__size")
    # Dealt by the same columns as the rows are, so no row moves once more.
    return placed.join(sizes.withColumn("__first", first).drop("__size"), [*groups, "__block"]).withColumn("__row", F.col("__row") + F.col("__first")).drop("__block", "__first")


def add_column(rows: DataFrame, key: str, conditional: DataFrame, groups: list[str], name: str, seed: int, bound: int | None = None, n: int | None = None) -> DataFrame:
    """rows with a new column whose values follow the conditional distribution in each group of equal `groups`, in counts by largest remainder.

    conditional has groups, name and prob, and `bound` rows, if that is known (else
    they are counted before a broadcast); n is the number of rows, if known. Rows
    of a group are numbered in a hashed order; a row takes the value whose range
    of numbers holds its own, found in an array of the group's range ends.
    """
    n = rows.count() if n is None else n
    placed = numbered_in_groups(rows, key, groups, f"{seed}:{name}", n)
    at = F.size(F.filter("__ends", lambda end: end <= F.col("__row"))) + 1
    if not groups:
        # One row for each value of a column, so at most its domain's size.
        counts = allocate(conditional.withColumnRenamed(name, "value"), F.lit(n), [])
        ranges = spread(counts, []).where("hi > lo").orderBy("hi").collect()
        kind = conditional.schema[name].dataType
        if not ranges:  # no rows, or no values
            return rows.where("false").withColumn(name, F.lit(None).cast(kind))
        held = placed.withColumn("__ends", F.array(*[F.lit(r["hi"]) for r in ranges]))
        values = F.array(*[F.lit(r["value"]).cast(kind) for r in ranges])
        return held.withColumn(name, F.element_at(values, at)).drop("__row", "__ends")
    hint = small if bound is None else F.broadcast if bound <= BROADCAST_ROWS else (lambda x: x)
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("__n"))
    counts = allocate(conditional.join(hint(sizes), groups).withColumnRenamed(name, "value"), F.col("__n"), groups)
    ranges = spread(counts, groups).where("hi > lo").groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("hi", "value"))).alias("__ranges"))
    ranges = hint(ranges.select(*groups, F.col("__ranges.hi").alias("__ends"), F.col("__ranges.value").alias("__values")))
    return placed.join(ranges, groups).withColumn(name, F.element_at("__values", at)).drop("__row", "__ends", "__values")


def order_of(model: Model) -> list[tuple[tuple, str]]:
    """(given attributes, new attribute) for each column: cliques by depth along the tree, given what the clique shares with what is drawn."""
    near: dict[int, list[int]] = {k: [] for k in range(len(model.parts))}
    for i, j in model.tree:
        near[i].append(j)
        near[j].append(i)
    out, have, seen = [], set(), set()
    for root in range(len(model.parts)):
        todo = [root]
        while todo:
            k = todo.pop()
            if k in seen:
                continue
            seen.add(k)
            given = [a for a in model.parts[k] if a in have]
            for a in model.parts[k]:
                if a not in have:
                    out.append((tuple(given), a))
                    given.append(a)
                    have.add(a)
            todo += sorted(near[k], reverse=True)
    return out


def synthesize(spark: SparkSession, model: Model, n: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """n rows drawn from the model: key and a code for each attribute.

    A column's conditional table is at most one clique's size. Lineage is cut
    by a checkpoint every few columns, if the session has a folder for it.
    """
    from marginalia.sources.tables import cut

    beliefs = model.propagate()
    rows = spark.range(n).withColumnRenamed("id", key)
    for k, (given, new) in enumerate(order_of(model)):
        table = marginal_table(model, beliefs, (*given, new))
        base = table.sum(-1, keepdims=True)
        p = np.where(base > 0, table / np.where(base > 0, base, 1), 1 / table.shape[-1])
        index = np.indices(p.shape).reshape(p.ndim, -1)
        data = [(*map(int, index[:, i]), float(v)) for i, v in enumerate(p.ravel())]
        schema = ", ".join([f"`{g}` int" for g in given] + [f"`{new}` int", "prob double"])
        rows = add_column(rows, key, spark.createDataFrame(data, schema), list(given), new, seed, len(data), n)
        if k % 4 == 3:
            rows = cut(rows)
    return rows


def marginal_table(model: Model, beliefs: list[Table], measure: tuple) -> np.ndarray:
    return model.marginal(measure, beliefs)
