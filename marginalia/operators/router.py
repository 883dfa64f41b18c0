"""One place to ask for marginals of a vertically split table: by whichever party or private statistic can answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import hierarchy as tree
from marginalia.operators import local_dp, marginals, sketch
from marginalia.operators.domain import Domain
from marginalia.operators.mrf import Model
from marginalia.operators.privacy import gaussian_mechanism


@dataclass
class Router:
    """models answer sets within one party; `across` answers all others.

    Answers are arrays with an axis for each attribute, clamped at 0 and kept
    for the next time. expand maps a set and its array to the full domain
    (binned attributes), and adjust maps all known answers to consistent ones.
    """

    models: list[tuple[set[str], Model]]
    across: Callable[[tuple[str, ...]], np.ndarray]
    total: float
    expand: Callable[[tuple[str, ...], np.ndarray], np.ndarray] | None = None
    known: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)

    def owner(self, attrs: tuple[str, ...]) -> Model | None:
        return next((m for own, m in self.models if set(attrs) <= own), None)

    def marginal(self, attrs: tuple[str, ...]) -> np.ndarray:
        if attrs not in self.known:
            model = self.owner(attrs)
            try:
                got = model.marginal(attrs) if model else self.across(attrs)
            except KeyError:  # no clique of the party's model holds the set
                got = independent([self.marginal((a,)) for a in attrs], self.total)
            if self.expand:
                got = self.expand(attrs, got)
            self.known[attrs] = np.maximum(got, 0.0)
        return self.known[attrs]


def independent(margins: list[np.ndarray], total: float) -> np.ndarray:
    out = np.array(float(total))
    for m in margins:
        out = np.multiply.outer(out, m / max(m.sum(), 1e-300))
    return out


def from_responses(reports: DataFrame, sizes: dict[str, int], epsilon: float, n: float) -> Callable[[tuple[str, ...]], np.ndarray]:
    """Answers from perturbed columns joined on the row's key."""

    def answer(attrs: tuple[str, ...]) -> np.ndarray:
        own = {a: sizes[a] for a in attrs}
        cells = local_dp.clamp_and_scale(local_dp.unbias(marginals.dense(reports, list(attrs), Domain.of(own)), own, epsilon), n).toPandas()
        out = np.zeros([sizes[a] for a in attrs])
        out[tuple(cells[a] for a in attrs)] = cells["value"]
        return out

    return answer


def from_sketches(sides: list[DataFrame], sizes: dict[str, int], n: int, m: int, gamma: float = 1.0, p: sketch.Privacy = sketch.Privacy()) -> Callable[[tuple[str, ...]], np.ndarray]:
    """Answers for pairs across two parties, all estimated in one pass, and for single attributes."""
    pairs = sketch.intersections(*sides, n, m, gamma, p).toPandas()
    singles = marginals.union_all([sketch.histogram(s, n, m, gamma, p) for s in sides]).toPandas()

    def answer(attrs: tuple[str, ...]) -> np.ndarray:
        if len(attrs) == 1:
            own = singles[singles["attr"] == attrs[0]]
            out = np.zeros(sizes[attrs[0]])
            out[own["value"].astype(int)] = own["count"]
            return out
        a, b = attrs
        own, turned = pairs[(pairs["attr_a"] == a) & (pairs["attr_b"] == b)], False
        if own.empty:
            own, turned = pairs[(pairs["attr_a"] == b) & (pairs["attr_b"] == a)], True
        one, two = (b, a) if turned else (a, b)
        out = np.zeros((sizes[one], sizes[two]))
        out[own["value_a"].astype(int), own["value_b"].astype(int)] = own["value"]
        return out.T if turned else out

    return answer


def reassemble(reports: list[DataFrame], key: str) -> DataFrame:
    """The parties' perturbed columns side by side."""
    out = reports[0]
    for r in reports[1:]:
        out = out.join(r, key)
    return out


def noisy_level_marginal(df: DataFrame, column: str, table: DataFrame, others: list[str], sigma: float, seed: int) -> DataFrame:
    """A noisy marginal of a rolled-up column, its sub-codes and other columns; cells that no code has are 0."""
    rolled = tree.roll_up(df.select(column, *others), column, table)
    keys = [column, f"{column}_sub", *others]
    cells = marginals.dense(rolled, keys).withColumn("value", F.col("value").cast("double"))
    return tree.structural_zeros(gaussian_mechanism(cells, keys, sigma, seed), column, table)
