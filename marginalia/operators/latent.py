"""Latent factors that explain total correlation: an Estimator-like pair over coded tables.

Each of `hidden` factors has `states` states. A pass over the data (the
E-step) gives each row's posteriors; one aggregate (the M-step) gives the
parameters. Rows stay in Spark in long form; parameters are a small table.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.hashing import uniform
from marginalia.operators.encode import small
from marginalia.operators.order import numbered
from marginalia.sources.tables import cut


@dataclass(frozen=True)
class Settings:
    hidden: int = 2
    states: int = 2
    rounds: int = 50
    tolerance: float = 1e-5
    smoothing: float = 1.0
    missing: int = -1
    seed: int = 0


def long_rows(df: DataFrame, columns: list[str], key: str, missing: int = -1) -> DataFrame:
    """(row_id, attr, x) without missing values."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("attr"), F.nullif(F.col(c).cast("int"), F.lit(missing)).alias("x")) for k, c in enumerate(columns)]))
    return df.select(F.col(key).alias("row_id"), parts.alias("p")).select("row_id", "p.attr", "p.x").where("x is not null")


def first_posteriors(rows: DataFrame, s: Settings) -> DataFrame:
    """(row_id, factor, state, p): random, by the row's hash."""
    ids = rows.select("row_id").distinct()
    each = ids.withColumn("factor", F.explode(F.sequence(F.lit(0), F.lit(s.hidden - 1)))).withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(s.states - 1))))
    raw = each.withColumn("w", -F.log(uniform(F.lit(s.seed), F.col("row_id"), F.col("factor"), F.col("state"))))
    return raw.select("row_id", "factor", "state", (F.col("w") / F.sum("w").over(Window.partitionBy("row_id", "factor"))).alias("p"))


def prior(posteriors: DataFrame) -> DataFrame:
    """(factor, state, prior): the mean posterior."""
    return posteriors.groupBy("factor", "state").agg(F.avg("p").alias("prior"))


def frequencies(rows: DataFrame, posteriors: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(attr, x, factor, state, joint, log_ratio): smoothed p(x | state) against p(x), for discrete attributes."""
    joint = rows.join(posteriors, "row_id").groupBy("attr", "x", "factor", "state").agg(F.sum("p").alias("joint"))
    of_attr = Window.partitionBy("attr", "factor")
    values = F.size(F.collect_set("x").over(of_attr))
    p_xy = (F.col("joint") + F.lit(smoothing) / values) / (F.sum("joint").over(Window.partitionBy("attr", "factor", "state")) + F.lit(smoothing))
    p_x = F.sum("joint").over(Window.partitionBy("attr", "factor", "x")) / F.sum("joint").over(of_attr)
    return joint.select("attr", "x", "factor", "state", "joint", (F.log(p_xy) - F.log(p_x)).alias("log_ratio"))


def gaussian_moments(values: DataFrame, posteriors: DataFrame, floor: float = 0.25) -> DataFrame:
    """(attr, factor, state, mean, variance) of real values (row_id, attr, x), with a least variance."""
    j = values.join(posteriors, "row_id")
    w, wx, wxx = F.sum("p"), F.sum(F.col("p") * F.col("x")), F.sum(F.col("p") * F.col("x") * F.col("x"))
    return j.groupBy("attr", "factor", "state").agg((wx / w).alias("mean"), F.greatest(F.lit(floor), wxx / w - (wx / w) * (wx / w)).alias("variance"))


def gaussian_log(x: Column, mean: Column, variance: Column) -> Column:
    return -(x - mean) * (x - mean) / (2 * variance) - F.log(variance * F.lit(2 * np.pi)) / 2


def posteriors(rows: DataFrame, theta: DataFrame, p: DataFrame, alpha: DataFrame | None = None) -> DataFrame:
    """(row_id, factor, state, p, log_z): the E-step; alpha has (attr, factor, alpha) weights, 1 if absent."""
    t = small(theta.select("attr", "x", "factor", "state", "log_ratio"))
    terms = rows.join(t, ["attr", "x"])
    if alpha is not None:
        terms = terms.join(small(alpha), ["attr", "factor"]).withColumn("log_ratio", F.col("log_ratio") * F.col("alpha"))
    logs = terms.groupBy("row_id", "factor", "state").agg(F.sum("log_ratio").alias("s")).join(small(p), ["factor", "state"]).withColumn("u", F.col("s") + F.log("prior"))
    w = Window.partitionBy("row_id", "factor")
    top = logs.withColumn("top", F.max("u").over(w))
    z = F.log(F.sum(F.exp(F.col("u") - F.col("top"))).over(w)) + F.col("top")
    return top.withColumn("log_z", z).select("row_id", "factor", "state", F.exp(F.col("u") - F.col("log_z")).alias("p"), "log_z")


def total_correlation(post: DataFrame) -> DataFrame:
    """(factor, tc): the mean log normalizer."""
    return post.groupBy("factor").agg((F.sum("log_z") / F.count("*")).alias("tc"))


def mutual_information(theta: DataFrame) -> DataFrame:
    """(attr, factor, mi) between each attribute and factor."""
    w = Window.partitionBy("attr", "factor")
    return theta.withColumn("share", F.col("joint") / F.sum("joint").over(w)).groupBy("attr", "factor").agg(F.sum(F.col("share") * F.col("log_ratio")).alias("mi"))


def structure(rows: DataFrame, theta: DataFrame, post: DataFrame) -> DataFrame:
    """(attr, factor, alpha): the share of rows in which a factor explains an attribute best, in greedy turn."""
    gain = rows.join(small(theta.select("attr", "x", "factor", "state", "log_ratio")), ["attr", "x"]).join(post.select("row_id", "factor", "state", "p"), ["row_id", "factor", "state"])
    per = gain.groupBy("row_id", "attr", "factor").agg(F.sum(F.col("p") * F.col("log_ratio")).alias("gain"))
    best = F.row_number().over(Window.partitionBy("row_id", "attr").orderBy(F.desc(F.round("gain", 12)), "factor"))
    return per.withColumn("first", (best == 1).cast("double")).groupBy("attr", "factor").agg(F.avg("first").alias("alpha"))


@dataclass
class Latent:
    """A fitted model."""

    settings: Settings
    theta: DataFrame
    prior: DataFrame
    alpha: DataFrame
    history: list[float]

    def transform(self, df: DataFrame, columns: list[str], key: str) -> DataFrame:
        """(row_id, factor, label): each row's most likely state of each factor."""
        post = posteriors(long_rows(df, columns, key, self.settings.missing), self.theta, self.prior, self.alpha)
        return post.groupBy("row_id", "factor").agg(F.max_by("state", F.struct(F.col("p"), -F.col("state"))).alias("label"))


    def save(self, path: str) -> None:
        from marginalia.sources.tables import write_text

        for name in ("theta", "prior", "alpha"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        write_text(self.theta.sparkSession, json.dumps({"settings": asdict(self.settings), "history": self.history}), f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Latent:
        from marginalia.sources.tables import read_text

        meta = json.loads(read_text(spark, f"{path}/meta"))
        return cls(Settings(**meta["settings"]), *[spark.read.parquet(f"{path}/{name}") for name in ("theta", "prior", "alpha")], meta["history"])


def fit(df: DataFrame, columns: list[str], key: str, s: Settings = Settings()) -> Latent:
    rows = cut(long_rows(df, columns, key, s.missing))
    post, alpha, history = cut(first_posteriors(rows, s)), None, []
    theta = p = None
    for k in range(s.rounds):
        theta, p = cut(frequencies(rows, post, s.smoothing)), cut(prior(post))
        if k:
            alpha = cut(structure(rows, theta, post))
        post = cut(posteriors(rows, theta, p, alpha))
        history.append(float(total_correlation(post).agg(F.sum("tc")).first()[0]))
        if k >= 10 and abs(np.mean(history[-5:]) - np.mean(history[-10:-5])) < s.tolerance:
            break
    return Latent(s, theta, p, alpha if alpha is not None else cut(structure(rows, theta, post)), history)


def information_beyond_chance(rows: DataFrame, post: DataFrame, copies: int = 20, share: float = 0.95, seed: int = 0) -> DataFrame:
    """(attr, factor, mi): mutual information less its mean over permuted posteriors, 0 where it is within their range.

    Each copy pairs rows with the posteriors of another row by a hashed order.
    """
    spark = rows.sparkSession
    real = mutual_information(frequencies(rows, post)).withColumnRenamed("mi", "real")
    ids = rows.select("row_id").distinct()
    order = numbered(ids, [F.col("row_id")], "place")
    made = None
    for k in range(copies):
        other = numbered(ids, [uniform(F.lit(f"{seed}:{k}"), F.col("row_id")), F.col("row_id")], "place").withColumnRenamed("row_id", "from")
        moved = order.join(other, "place").select("row_id", "from").join(post.select(F.col("row_id").alias("from"), "factor", "state", "p"), "from").drop("from")
        mi = mutual_information(frequencies(rows, moved))
        made = mi if made is None else made.unionByName(mi)
    made = cut(made) if made is not None else spark.createDataFrame([], "attr int, factor int, mi double")
    chance = made.groupBy("attr", "factor").agg(F.avg("mi").alias("mean"), F.expr(f"percentile(mi, {share})").alias("high"))
    return real.join(chance, ["attr", "factor"]).select("attr", "factor", F.when(F.col("real") <= F.col("high"), 0.0).otherwise(F.col("real") - F.col("mean")).alias("mi"))
