"""How well a synthetic table serves: marginal distances and what a classifier learns from it."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import marginals, sketch


def random_sets(columns: list[str], k: int, number: int, seed: int) -> list[list[str]]:
    """Distinct random sets of k columns, in the columns' order."""
    r, out = random.Random(seed), {}
    for _ in range(number):
        out[tuple(sorted(r.sample(columns, min(k, len(columns))), key=columns.index))] = None
    return [list(s) for s in out]


def marginal_distance(real: DataFrame, made: DataFrame, columns: list[str], ways=(3, 4, 5), number: int = 300, seed: int = 0) -> DataFrame:
    """(k, tvd): the mean distance over random k-way marginals."""
    parts = []
    for k in ways:
        sets = random_sets(columns, k, number, seed + k)
        parts.append(marginals.utility(real, made, sets).agg(F.avg("tvd").alias("tvd")).select(F.lit(k).alias("k"), "tvd"))
    return marginals.union_all(parts)


def misclassification(train: DataFrame, test: DataFrame, columns: list[str], target: str, method: str = "forest", seed: int = 0) -> float:
    """The share of test rows whose target a classifier trained on `train` gets wrong. test must not be part of train.

    method: "rbf" is a machine with a Gaussian kernel exp(-|x - y|^2 / d) over d
    scaled columns, which inner products of FOURIER random cosines stand for;
    "svm" is the linear one; "forest" a random forest.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    inputs = [c for c in columns if c != target]
    scale = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="features", withMean=True)])
    label = F.col(target).cast("double").alias("label")
    known, asked = train.select(*inputs, label), test.select(*inputs, label)
    scaler = scale.fit(known)
    known, asked = scaler.transform(known), scaler.transform(asked)
    if method == "rbf":
        known, asked = (fourier_features(x, len(inputs), seed) for x in (known, asked))
    machine = RandomForestClassifier(labelCol="label", seed=seed, numTrees=50) if method == "forest" else OneVsRest(classifier=LinearSVC(maxIter=50), labelCol="label")
    predicted = machine.fit(known).transform(asked)
    return 1.0 - MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predicted)


#: Random cosines that stand for a Gaussian kernel.
FOURIER = 256


def fourier_features(df: DataFrame, d: int, seed: int, number: int = FOURIER) -> DataFrame:
    """df with `features`, a vector of d numbers, replaced by sqrt(2 / number) cos(w x + b) for random w and b.

    Inner products of two such vectors come near the kernel exp(-|x - y|^2 / d).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 / d) ** 0.5, (d, number)), rng.uniform(0, 2 * np.pi, number)

    @F.pandas_udf("array<double>")
    def cosines(x: pd.Series) -> pd.Series:
        return pd.Series(list((2 / number) ** 0.5 * np.cos(np.stack(x.to_list()) @ w + b)) if len(x) else [])

    return df.withColumn("features", array_to_vector(cosines(vector_to_array("features"))))


def sketch_accuracy(spark: SparkSession, sizes: list[int], m: int, repeats: int, gamma: float = 1.0, p: sketch.Privacy = sketch.Privacy(), seed: int = 0) -> DataFrame:
    """(size, repeat, estimate, error): how far sketches of sets of known size are off, as a share of the size."""
    every = marginals.union_all([spark.range(n).select(F.lit(n).alias("size"), "id") for n in sizes]).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keyed = every.select("size", "repeat", F.concat_ws("|", "size", "repeat", "id").alias("key"))
    alpha = sketch.levels(keyed, "key", m, gamma).groupBy("seed", F.col("size").alias("attr"), F.col("repeat").alias("value")).agg(F.max("level").alias("alpha"))
    found = sketch.privatize(alpha, p, gamma, seed).groupBy(F.col("attr").alias("size"), F.col("value").alias("repeat")).agg((sketch.estimate(F.col("alpha"), m, gamma) - F.lit(float(p.phantoms))).alias("estimate"))
    return found.withColumn("error", F.abs(F.col("estimate") - F.col("size")) / F.col("size"))


def experiment(real: DataFrame, make, columns: list[str], name: str, epsilons=(0.4, 0.8, 1.6, 3.2), repeats: int = 5, ways=(3, 4, 5), number: int = 300) -> DataFrame:
    """(epsilon, data, repeat, k, tvd) of synthetic tables made by make(epsilon, repeat)."""
    parts = []
    for e in epsilons:
        for r in range(repeats):
            d = marginal_distance(real, make(e, r), columns, ways, number, seed=r)
            parts.append(d.select(F.lit(float(e)).alias("epsilon"), F.lit(name).alias("data"), F.lit(r).alias("repeat"), "k", "tvd"))
    return marginals.union_all(parts)


def cross_validated(df: DataFrame, make, columns: list[str], target: str, key: str, k: int = 5, seed: int = 0, method: str = "forest") -> float:
    """The mean misclassification over folds of a classifier trained on make(training rows) and tested on the rows held out."""
    from marginalia.operators.relations import folds

    dealt = folds(df, key, seed, k).persist()
    try:
        wrong = [misclassification(make(dealt.where(F.col("fold") != f).drop("fold")), dealt.where(F.col("fold") == f), columns, target, method, seed) for f in range(k)]
    finally:
        dealt.unpersist()
    return sum(wrong) / k
