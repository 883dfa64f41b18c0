"""From raw columns to codes and back: dictionaries, bins, and un-binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.hashing import laplace, uniform
from marginalia.operators.domain import Domain
from marginalia.operators.order import numbered

#: Dictionaries and value tables above this many rows are joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values as text in lexicographic order, from 0."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return numbered(values, [F.col("value")], "code").withColumn("code", F.col("code").cast("int"))


def dictionaries(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    return {c: dictionary(df, c) for c in columns}


def encode(df: DataFrame, columns: list[str], keys: list[str], books: dict[str, DataFrame] | None = None) -> DataFrame:
    """keys and, for each column, its code; a value that the dictionary lacks has none."""
    books = books or dictionaries(df, columns)
    out = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    for c in columns:
        book = books[c].select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        out = out.join(small(book), c, "left")
    return out.select(*keys, *[F.col(f"{c}_code").alias(c) for c in columns])


def decode(coded: DataFrame, columns: list[str], keys: list[str], books: dict[str, DataFrame]) -> DataFrame:
    """The inverse of encode."""
    out = coded.select(*keys, *columns)
    for c in columns:
        book = books[c].select(F.col("code").alias(c), F.col("value").alias(f"{c}_value"))
        out = out.join(small(book), c, "left")
    return out.select(*keys, *[F.col(f"{c}_value").alias(c) for c in columns])


def domain_of(books: dict[str, DataFrame]) -> Domain:
    return Domain.of({c: b.count() for c, b in books.items()})


def equal_width(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of x: right-closed bins of equal width, the least value in the first."""
    width = (high - low) / F.lit(float(bins))
    at = F.ceil((x - low) / width) - 1
    return F.when(high == low, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), at))).cast("int")


def slack_width(x: Column, low: Column, high: Column, bins: int = 16) -> Column:
    """Code of a continuous value, with a slack of one: the value stays below while x <= low + (code + 1) * width + 1."""
    width = (high - low) / F.lit(float(bins))
    return F.when(high == low, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((x - F.lit(1.0) - low) / width) - 1)).cast("int")


def binned(df: DataFrame, column: str, bins: int, keys: list[str], rule=equal_width) -> DataFrame:
    """keys, value and bin; the ends come from one aggregate row."""
    ends = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")).first()
    bin_ = rule(F.col(column).cast("double"), F.lit(ends["low"]).cast("double"), F.lit(ends["high"]).cast("double"), bins)
    return df.select(*keys, F.col(column).alias("value"), bin_.alias("bin"))


def conditional(rows: DataFrame) -> DataFrame:
    """(bin, value, n, prob, cum_lo, cum_hi) of rows with bin and value: the distribution of values in each bin."""
    counts = rows.groupBy("bin", "value").agg(F.count("*").alias("n"))
    per_bin = Window.partitionBy("bin")
    upto = per_bin.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(per_bin)
    return counts.select(
        "bin", "value", "n",
        (F.col("n") / total).alias("prob"),
        ((F.sum("n").over(upto) - F.col("n")) / total).alias("cum_lo"),
        (F.sum("n").over(upto) / total).alias("cum_hi"),
    )


def unbin(rows: DataFrame, table: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """keys and a value drawn from the row's bin by its conditional distribution; u depends on the keys alone.

    The bin is an equi-join; the range on u only filters within it.
    """
    drawn = rows.withColumn("u", uniform(F.lit(seed), *[F.col(k) for k in keys]))
    t = small(table.select(F.col("bin"), F.col("value").alias("drawn"), "cum_lo", "cum_hi"))
    hit = drawn.join(t, "bin").where("u >= cum_lo and u < cum_hi")
    return hit.select(*keys, "bin", F.col("drawn").alias("value"))


def expand_bins(marginal: DataFrame, tables: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """A marginal over bins as one over values: each cell times the conditional probabilities of its axes."""
    out = marginal
    for axis, t in tables.items():
        t = small(t.select(F.col("bin").alias(axis), F.col("value").alias(f"{axis}_value"), F.col("prob").alias(f"{axis}_prob")))
        out = out.join(t, axis).withColumn(value, F.col(value) * F.col(f"{axis}_prob")).drop(axis, f"{axis}_prob").withColumnRenamed(f"{axis}_value", axis)
    return out


def private_quantile_bins(df: DataFrame, column: str, bins: int, scale: float, seed: int) -> DataFrame:
    """(value, bin, noisy): bins of equal noisy frequency; Laplace noise of the given scale on each count, clamped at 0."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    noisy = counts.select("value", F.greatest(F.lit(0.0), F.col("n") + laplace(scale, F.lit(seed), F.col("value"))).alias("noisy"))
    every = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("noisy").over(Window.partitionBy())
    cum = F.sum("noisy").over(every)
    at = F.when(total > 0, F.ceil(cum * F.lit(bins) / total) - 1).otherwise(F.lit(0))
    return noisy.select("value", F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).cast("int").alias("bin"), "noisy")
