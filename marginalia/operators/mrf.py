"""Markov random fields over coded attributes: belief propagation and fitting.

A model is a junction tree of cliques with log-potentials. Its tables are
bounded by the limits of the graph search (some hundred thousand cells), so
fitting runs on the driver with NumPy; the counts it is fitted to are made by
Spark. `propagate_tables` does the same steps as a Spark plan over long
tables, for models whose cliques are large.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import marginals
from marginalia.operators.graph import Graph, cliques, junction_tree, schedule, triangulate


@dataclass
class Table:
    """A dense factor: attributes and an array with an axis for each."""

    attrs: tuple
    values: np.ndarray

    def onto(self, attrs: tuple) -> np.ndarray:
        """The array with axes for attrs, of length 1 where this table has none."""
        order = [self.attrs.index(a) for a in attrs if a in self.attrs]
        shape = [self.values.shape[self.attrs.index(a)] if a in self.attrs else 1 for a in attrs]
        return self.values.transpose(order).reshape(shape)

    def sum_to(self, attrs: tuple) -> Table:
        keep = tuple(a for a in self.attrs if a in attrs)
        return Table(keep, self.values.sum(tuple(k for k, a in enumerate(self.attrs) if a not in attrs)))

    def log_sum_to(self, attrs: tuple) -> Table:
        keep = tuple(a for a in self.attrs if a in attrs)
        gone = tuple(k for k, a in enumerate(self.attrs) if a not in attrs)
        if not gone:
            return self
        top = self.values.max(gone, keepdims=True)
        return Table(keep, np.log(np.exp(self.values - top).sum(gone)) + top.reshape([s for k, s in enumerate(self.values.shape) if k not in gone]))


@dataclass
class Model:
    sizes: dict
    parts: list[tuple]
    tree: list[tuple[int, int]]
    total: float
    theta: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, graph: Graph, sizes: dict, total: float) -> Model:
        parts = cliques(triangulate(graph))
        return cls(sizes, parts, junction_tree(parts), total, [np.zeros([sizes[a] for a in p]) for p in parts])

    def home(self, measure: tuple) -> int:
        """The first clique that contains a measure."""
        for k, p in enumerate(self.parts):
            if set(measure) <= set(p):
                return k
        raise KeyError(measure)

    def propagate(self, theta: list[np.ndarray] | None = None) -> list[Table]:
        """The cliques' marginals, each summing to the total."""
        beliefs = [Table(p, t) for p, t in zip(self.parts, theta if theta is not None else self.theta)]
        sent: dict[tuple[int, int], Table] = {}
        for i, j in schedule(self.tree):
            common = tuple(a for a in self.parts[i] if a in self.parts[j])
            body = beliefs[i].values
            if (j, i) in sent:
                body = body - sent[j, i].onto(self.parts[i])
            sent[i, j] = Table(self.parts[i], body).log_sum_to(common)
            beliefs[j] = Table(self.parts[j], beliefs[j].values + sent[i, j].onto(self.parts[j]))
        out = []
        for b in beliefs:
            p = np.exp(b.values - b.values.max())
            out.append(Table(b.attrs, p * self.total / p.sum()))
        return out

    def marginal(self, measure: tuple, beliefs: list[Table] | None = None) -> np.ndarray:
        beliefs = beliefs or self.propagate()
        got = beliefs[self.home(measure)].sum_to(measure)
        return got.values.transpose([got.attrs.index(a) for a in measure])

    def entropy(self) -> float:
        """log Z less the mean of the potentials under the model."""
        beliefs = self.propagate()
        h = lambda x: -(p := x[x > 0] / self.total) @ np.log(p)
        total = sum(h(b.values.ravel()) for b in beliefs)
        for i, j in self.tree:
            common = tuple(a for a in self.parts[i] if a in self.parts[j])
            if common:
                total -= h(beliefs[i].sum_to(common).values.ravel())
        return float(total)

    def loss(self, measured: dict[tuple, np.ndarray], beliefs: list[Table]) -> tuple[float, list[np.ndarray]]:
        """Half the squared distance to the measured marginals, and its gradient lifted to the cliques."""
        gradient, total = [np.zeros_like(t) for t in self.theta], 0.0
        for measure, y in measured.items():
            k = self.home(measure)
            d = self.marginal(measure, beliefs) - y
            total += 0.5 * float((d * d).sum())
            gradient[k] = gradient[k] + Table(measure, d).onto(self.parts[k])
        return total, gradient

    def fit(self, measured: dict[tuple, np.ndarray], steps: int = 1000, halvings: int = 25, tolerance: float = 1e-9) -> list[float]:
        """Mirror descent with halved steps while a step falls short of half the promised descent; the losses."""
        step, losses = 2.0 / self.total**2, []
        beliefs = self.propagate()
        loss, gradient = self.loss(measured, beliefs)
        for _ in range(steps):
            losses.append(loss)
            step *= 2
            for _ in range(halvings):
                theta = [t - step * g for t, g in zip(self.theta, gradient)]
                after = self.propagate(theta)
                new, new_gradient = self.loss(measured, after)
                promised = sum(float((g * (a.values - b.values)).sum()) for g, a, b in zip(gradient, after, beliefs))
                if np.isfinite(new) and new - loss <= 0.5 * promised:
                    break
                step /= 2
            else:
                break
            done = abs(loss - new) <= tolerance * max(loss, 1.0)
            self.theta, beliefs, loss, gradient = theta, after, new, new_gradient
            if done:
                break
        losses.append(loss)
        return losses

    # Stored as a table and a line of JSON

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, i, float(v)) for k, t in enumerate(self.theta) for i, v in enumerate(t.ravel())]
        spark.createDataFrame(rows, "clique int, cell long, potential double").write.mode("overwrite").parquet(f"{path}/potentials")
        meta = json.dumps({"sizes": self.sizes, "parts": self.parts, "tree": self.tree, "total": self.total})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        model = cls(meta["sizes"], [tuple(p) for p in meta["parts"]], [tuple(e) for e in meta["tree"]], meta["total"])
        model.theta = [np.zeros([model.sizes[a] for a in p]) for p in model.parts]
        for r in spark.read.parquet(f"{path}/potentials").collect():
            model.theta[r["clique"]].ravel()[r["cell"]] = r["potential"]
        return model


def candidates(parts: list[tuple], sizes: dict, most: int = 3, limit: float = 1e6) -> dict[tuple, float]:
    """Proper subsets of the cliques within the limit, with weights that favour large cliques: len^2 over the number of subsets."""
    out: dict[tuple, float] = {}
    for p in parts:
        own = [s for k in range(1, min(most, max(1, len(p) - 1)) + 1) for s in combinations(p, k) if np.prod([sizes[a] for a in s]) <= limit]
        for s in own:
            out[s] = out.get(s, 0.0) + len(p) ** 2 / len(own)
    return out


def propagate_tables(potentials: dict[int, DataFrame], parts: list[tuple], tree: list[tuple[int, int]], total: float) -> dict[int, DataFrame]:
    """Belief propagation as a plan: potentials by clique number are long tables with a log value; marginals come back the same way."""
    beliefs, sent = dict(potentials), {}
    for i, j in schedule(tree):
        common = [a for a in parts[i] if a in parts[j]]
        body = beliefs[i]
        if (j, i) in sent:
            body = marginals.combine(body, sent[j, i], lambda x, y: x - y)
        sent[i, j] = marginals.log_sum_exp(body, common)
        beliefs[j] = marginals.add(beliefs[j], sent[i, j])
    return {k: marginals.normalize(b.withColumn("value", F.exp("value")), F.lit(float(total))) for k, b in beliefs.items()}


def log_partition(potential: DataFrame) -> DataFrame:
    return marginals.log_sum_exp(potential, [])


def theoretic_loss(cell_counts: list[int], sigma: float) -> float:
    """What noise alone is expected to leave."""
    return 0.5 * sum(cell_counts) * sigma**2
