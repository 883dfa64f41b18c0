"""Contingency tables, factors over them, and the scores made from them.

A marginal is a long table: one column for each attribute and a value. Counts
are made by one aggregate over the columns asked for; a batch of marginals is
one pass with grouping sets over pre-aggregated rows. Zero cells are filled in
where they matter, from the cells' numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.domain import Domain, grid
from marginalia.operators.encode import small

#: Dense tables are refused above this many cells.
MAX_CELLS = 50_000_000


def sparse(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that occur, with their counts."""
    return df.groupBy(*columns).agg(F.count("*").alias("value"))


def axis(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """All combinations of the values that occur in each column.

    The axes are numbered; combinations are decoded from a range of numbers,
    and each axis joined on its number.
    """
    sizes, tables = [], []
    for c in columns:
        t = axis(df, c).withColumn(f"{c}__at", (F.row_number().over(Window.orderBy(c)) - 1).cast("int"))
        tables.append(t)
        sizes.append(t.count())
    domain = Domain.of({f"{c}__at": n for c, n in zip(columns, sizes)})
    if domain.size > MAX_CELLS:
        raise ValueError(f"{domain.size} cells; the limit is {MAX_CELLS}")
    out = grid(df.sparkSession, domain)
    for c, t in zip(columns, tables):
        out = out.join(small(t), f"{c}__at").drop(f"{c}__at")
    return out.select(*columns)


def dense(df: DataFrame, columns: list[str], domain: Domain | None = None) -> DataFrame:
    """All cells with their counts, zeros included; the domain's codes, or the values that occur."""
    all_cells = grid(df.sparkSession, domain.reorder(columns)) if domain else cells(df, columns)
    counts = sparse(df, columns)
    return all_cells.join(counts, columns, "left").select(*columns, F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def batch(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Several marginals in one pass: set_id (a bit for each column that isn't in the set), the columns, value."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    counts = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    grouped = counts.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.sum("__n").alias("value"), F.grouping_id(*columns).alias("set_id")).select("set_id", *columns, "value")


def entropy(counts: DataFrame, value: str = "value") -> DataFrame:
    """Natural-log entropy of a marginal, one row."""
    total = F.sum(value)
    # H = ln n - sum(c ln c) / n, in one aggregate.
    plogp = F.sum(F.when(F.col(value) > 0, F.col(value) * F.log(F.col(value).cast("double"))).otherwise(0.0))
    return counts.agg((F.log(total.cast("double")) - plogp / total).alias("entropy"))


def pair_entropies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, h_a, h_b, h_ab, mutual_information) of each pair, by one batch of marginals."""
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    ids = {}
    for s in [[c] for c in columns] + [list(p) for p in pairs]:
        ids[frozenset(s)] = sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in s)
    counts = batch(df, [[c] for c in columns] + [list(p) for p in pairs])
    plogp = F.sum(F.col("value") * F.log(F.col("value").cast("double")))
    h = counts.groupBy("set_id").agg((F.log(F.sum("value").cast("double")) - plogp / F.sum("value")).alias("h"))
    known = df.sparkSession.createDataFrame([(a, b, ids[frozenset([a])], ids[frozenset([b])], ids[frozenset([a, b])]) for a, b in pairs], "a string, b string, id_a long, id_b long, id_ab long")
    for side in ("a", "b", "ab"):
        known = known.join(h.select(F.col("set_id").cast("long").alias(f"id_{side}"), F.col("h").alias(f"h_{side}")), f"id_{side}")
    return known.select("a", "b", "h_a", "h_b", "h_ab", (F.col("h_a") + F.col("h_b") - F.col("h_ab")).alias("mutual_information"))


def dependence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Total variation between the pair's table and independence: half the mean absolute difference over all cells.

    Cells that don't occur add n_a n_b / n each; their sum is n less that of
    the cells that do, so no zero cell is made.
    """
    joint = sparse(df, [a, b]).withColumnRenamed("value", "n_ab")
    n_a = F.sum("n_ab").over(Window.partitionBy(a))
    n_b = F.sum("n_ab").over(Window.partitionBy(b))
    n = joint.agg(F.sum("n_ab")).scalar()
    expected = joint.select("n_ab", (n_a * n_b / n).alias("e"), n.alias("n"))
    return expected.agg(((F.sum(F.abs(F.col("e") - F.col("n_ab"))) + F.max("n") - F.sum("e")) / (2 * F.max("n"))).alias("tvd"))


def cross_dependence(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(attr_a, attr_b, tvd) for each pair of a left and a right attribute, the largest first.

    One batch of marginals in long form: attributes and values as text.
    """
    pairs = [(a, b) for a in left for b in right]
    counts = df.groupBy(*left, *right).agg(F.count("*").alias("n"))
    long = counts.select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("attr_a"), F.lit(b).alias("attr_b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")) for a, b in pairs])).alias("p"))
    joint = long.groupBy("p.attr_a", "p.attr_b", "p.va", "p.vb").agg(F.sum("n").alias("n_ab"))
    pair = ["attr_a", "attr_b"]
    e = joint.select(
        *pair, "n_ab",
        F.sum("n_ab").over(Window.partitionBy(*pair)).alias("n"),
        (F.sum("n_ab").over(Window.partitionBy(*pair, "va")) * F.sum("n_ab").over(Window.partitionBy(*pair, "vb")) / F.sum("n_ab").over(Window.partitionBy(*pair))).alias("e"),
    )
    return e.groupBy(*pair).agg(((F.sum(F.abs(F.col("e") - F.col("n_ab"))) + F.max("n") - F.sum("e")) / (2 * F.max("n"))).alias("tvd")).orderBy(F.desc("tvd"), *pair)


def l1(model: DataFrame, data: DataFrame, columns: list[str], n: Column) -> DataFrame:
    """Half the mean absolute difference of two marginals; cells that one side lacks count as 0 there."""
    a, b = model.withColumnRenamed("value", "m"), data.withColumnRenamed("value", "d")
    both = a.join(b, columns, "full")
    return both.agg((F.sum(F.abs(F.coalesce("m", F.lit(0.0)) - F.coalesce("d", F.lit(0.0)))) / 2 / n).alias("l1"))


def losses(clean: DataFrame, private: DataFrame, model: DataFrame, columns: list[str], n: Column) -> DataFrame:
    """(private_clean, model_private, model_clean): how far the noisy marginal is from the clean one, and the model's from both."""
    named = [t.select(*columns, F.col("value").cast("double").alias(name)) for t, name in ((clean, "c"), (private, "p"), (model, "m"))]
    all_cells = reduce(lambda x, y: x.join(y, columns, "full"), named)
    far = lambda a, b: (F.sum(F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))) / 2 / n).alias
    return all_cells.agg(far("p", "c")("private_clean"), far("m", "p")("model_private"), far("m", "c")("model_clean"))


def utility(real: DataFrame, made: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(set_id, tvd) of each marginal between a table and a synthetic one, rescaled to the table's size.

    Both sides are one batch, counted together: real rows weigh 1 / n, made
    rows -1 / m, so no join is needed.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))

    def shares(df: DataFrame, sign: int) -> DataFrame:
        return df.groupBy(*columns).agg((F.lit(sign) * F.count("*") / F.lit(max(1, df.count()))).alias("__w"))

    both = shares(real, 1).unionByName(shares(made, -1))
    by_cell = both.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.sum("__w").alias("__w"), F.grouping_id(*columns).alias("__set"))
    return by_cell.groupBy(F.col("__set").alias("set_id")).agg((F.sum(F.abs("__w")) / 2).alias("tvd"))


# Factors: marginals with real values


def combine(a: DataFrame, b: DataFrame, op, value: str = "value") -> DataFrame:
    """The natural join of two factors with their values combined; without a common attribute every cell meets every cell."""
    shared = [c for c in a.columns if c in b.columns and c != value]
    right = b.withColumnRenamed(value, "__other")
    both = a.join(right, shared) if shared else a.crossJoin(right)
    keep = [c for c in a.columns if c != value] + [c for c in b.columns if c not in a.columns]
    return both.select(*keep, op(F.col(value), F.col("__other")).alias(value))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x * y)


def ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """a / b; 0 where b is 0."""
    return combine(a, b, lambda x, y: F.when(y == 0, 0.0).otherwise(x / y))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x + y)


def sum_out(factor: DataFrame, keep: list[str], value: str = "value") -> DataFrame:
    return factor.groupBy(*keep).agg(F.sum(value).alias(value))


def log_sum_exp(factor: DataFrame, keep: list[str], value: str = "value") -> DataFrame:
    """Sums out in log space; the largest value is taken off first."""
    top = factor.groupBy(*keep).agg(F.max(value).alias("__top"))
    joined = factor.join(top, keep) if keep else factor.crossJoin(top)
    return joined.groupBy(*keep).agg((F.max("__top") + F.log(F.sum(F.exp(F.col(value) - F.col("__top"))))).alias(value))


def normalize(factor: DataFrame, total: Column, value: str = "value") -> DataFrame:
    return factor.withColumn(value, F.col(value) * total / factor.agg(F.sum(value)).scalar())


def inner(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The inner product of two potentials in long form."""
    return a.join(b.withColumnRenamed("value", "__other"), keys).agg(F.sum(F.col("value") * F.col("__other")).alias("dot"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
