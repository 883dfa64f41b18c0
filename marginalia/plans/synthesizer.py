"""From tables to private synthetic tables: one holder of all columns, or two parties that share row keys.

Spark makes every count, sketch and sampled row; the driver keeps the graph
and the model, whose size the limits bound. Domains (which values a column
has) are taken to be public; everything else that leaves the data has noise
and an entry in a ledger that refuses to go over the budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators import encode as enc
from marginalia.operators import graph as gr
from marginalia.operators import local_dp, mrf, sketch, synthesis
from marginalia.operators import marginals as mg
from marginalia.operators import privacy as dp
from marginalia.operators.domain import Domain, encode_index

KEY = "row_id"
#: Cells that one pass brings to the driver, about.
PASS_CELLS = 2e6


def batches_of(measures: list[tuple], sizes: dict[str, int], limit: float = PASS_CELLS) -> list[list[tuple]]:
    """The measures in runs whose tables have about limit cells; a larger one stands alone."""
    out, held = [], limit + 1.0
    for m in measures:
        cells = float(np.prod([float(sizes[a]) for a in m]))
        if held + cells > limit:
            out.append([])
            held = 0.0
        out[-1].append(m)
        held += cells
    return out


def measured_tables(coded: DataFrame, sizes: dict[str, int], measures: list[tuple], sigma: float, seed: int) -> dict[tuple, np.ndarray]:
    """Noisy dense marginals of all measures as arrays, counted in passes of PASS_CELLS cells."""
    rng, out = np.random.default_rng(seed), {}
    for part in batches_of(measures, sizes):
        for m, table in _counted(coded, sizes, part).items():
            noisy = table + (rng.normal(0, sigma, table.shape) if sigma else 0.0)
            out[m] = np.maximum(noisy, 0.0)
    return out


def _counted(coded: DataFrame, sizes: dict[str, int], measures: list[tuple]) -> dict[tuple, np.ndarray]:
    """Exact marginals; a cell travels as (set, number, count)."""
    columns = list(dict.fromkeys(c for m in measures for c in m))
    counts = mg.batch(coded, [list(m) for m in measures])
    got = {m: (sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in m), [sizes[a] for a in m]) for m in measures}
    number = F.lit(None).cast("long")
    for m, (mask, shape) in got.items():
        number = F.when(F.col("set_id") == mask, encode_index([F.col(a) for a in m], shape)).otherwise(number)
    rows = counts.select("set_id", number.alias("cell"), "value").toPandas()
    by_set = {k: g for k, g in rows.groupby("set_id")}
    out = {}
    for m, (mask, shape) in got.items():
        table = np.zeros(int(np.prod(shape)))
        if mask in by_set:
            table[by_set[mask]["cell"].to_numpy(np.int64)] = by_set[mask]["value"].to_numpy()
        out[m] = table.reshape(shape)
    return out


def pair_scores(coded: DataFrame, pairs: list[tuple[str, str]]) -> dict:
    """Dependence of each pair, a row for each, from one table of pair counts."""
    if not pairs:
        return {}
    total = max(1, coded.count())
    long = coded.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.col(a).cast("int").alias("va"), F.col(b).cast("int").alias("vb")) for k, (a, b) in enumerate(pairs)])).alias("p"))
    joint = long.groupBy("p.pair", "p.va", "p.vb").agg(F.count("*").alias("n"))
    margin = F.sum("n").over(Window.partitionBy("pair", "va")) * F.sum("n").over(Window.partitionBy("pair", "vb")) / F.lit(float(total))
    score = (F.sum(F.abs(F.col("e") - F.col("n"))) + F.lit(float(total)) - F.sum("e")) / F.lit(2.0 * total)
    rows = joint.select("pair", "n", margin.alias("e")).groupBy("pair").agg(score.alias("score")).collect()
    return {gr.Edge(pairs[r["pair"]]): float(r["score"]) for r in rows}


@dataclass
class Synthesizer:
    """Fit a graphical model to noisy marginals of a table and draw rows from it."""

    epsilon: float = 1.0
    delta: float = 1e-5
    seed: int = 0
    clique_cells: float = 1e5
    all_cells: float = 3e5
    #: Rounds in which tables are selected and measured; None: as many as the noise is planned for.
    rounds: int | None = None
    max_steps: int = 1000
    noiseless: bool = False
    #: "distance" takes the candidates whose noisy distance from the model is largest; "exponential" draws them by the exponential mechanism.
    select: str = "distance"
    #: Of the budget, for the number of rows if `fit` isn't given one.
    count_share: float = 0.05
    model: mrf.Model | None = None
    books: dict = field(default_factory=dict)
    columns: list = field(default_factory=list)
    rows: int = 0
    losses: list = field(default_factory=list)
    ledger: dp.Ledger | None = None
    plan: dp.ModelNoise | None = None
    #: Entropy of the model after each round.
    entropies: list = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> Synthesizer:
        self.columns = columns or df.columns
        self.books = enc.dictionaries(df, self.columns)
        coded = enc.encode(df, self.columns, [], self.books).where(" and ".join(f"`{c}` is not null" for c in self.columns)).persist()
        try:
            self._fit(coded, enc.domain_of(self.books))
        finally:
            coded.unpersist()
        return self

    def _fit(self, coded: DataFrame, domain: Domain, n: float | None = None) -> None:
        """n: the number of rows, if it is known without a look at them."""
        sizes = dict(domain.items())
        rng = np.random.default_rng(self.seed)
        budget = dp.gaussian_budget(self.epsilon, self.delta)
        self.ledger = dp.Ledger(budget)
        share = self.count_share if n is None and not self.noiseless else 0.0
        if n is None:
            n = float(coded.count())
            if share:
                sigma = dp.noise_for(1, share, budget)
                self.ledger.spend("number of rows", 1, 1.0, sigma)
                n = max(1.0, round(n + rng.normal(0, sigma)))
        self.rows = int(n)
        pairs = list(combinations(self.columns, 2))
        scores = pair_scores(coded, pairs)
        if not self.noiseless and pairs:
            each = dp.noise_for(len(pairs), dp.ModelNoise.graph_share, budget)
            self.ledger.spend("scores of pairs", len(pairs), 1.0, each)
            scores = {k: max(0.0, v + rng.normal(0, dp.tvd_sensitivity(n) * each)) for k, v in scores.items()}
        graph = gr.search(self.columns, scores, sizes, 1e-6, self.clique_cells, self.all_cells)
        measures = gr.network_measures(graph, scores, sizes, self.clique_cells)
        missing = set(self.columns) - {a for m in measures for a in m}
        measures += [(a,) for a in sorted(missing)]
        self.plan = plan = dp.ModelNoise(len(measures), len(self.columns), budget, n, count_share=share)
        self.model = mrf.Model.of(graph, sizes, n)
        held = self._measured(coded, sizes, measures, 0)
        self.losses = self.model.fit(held, self.max_steps)
        self.entropies = [self.model.entropy()]
        limit = self.clique_cells if self.noiseless else min(self.clique_cells, plan.cell_limit)
        others = [m for m in mrf.candidates(self.model.parts, sizes, 3, limit) if m not in held]
        rounds, left = min(self.rounds or plan.steps, max(1, plan.later)), plan.later
        for k in range(rounds):
            take = min(len(others), -(-left // (rounds - k)))
            if not take:
                break
            new = self._selected(coded, sizes, others, take, rounds, rng)
            held |= self._measured(coded, sizes, new, 1 + k)
            others, left = [m for m in others if m not in held], left - take
            self.losses += self.model.fit(held, self.max_steps)
            self.entropies.append(self.model.entropy())

    def _measured(self, coded: DataFrame, sizes: dict[str, int], measures: list[tuple], k: int) -> dict[tuple, np.ndarray]:
        """Tables that the model is fitted to, with the noise planned for each."""
        sigma = 0.0 if self.noiseless else self.plan.sigma
        if sigma:
            self.ledger.spend("tables", len(measures), 1.0, sigma)
        return measured_tables(coded, sizes, measures, sigma, self.seed + k)

    def _selected(self, coded: DataFrame, sizes: dict[str, int], others: list[tuple], take: int, rounds: int, rng: np.random.Generator) -> list[tuple]:
        """The candidates farthest from the model, by distances with a noise of their own; one row moves a distance by 1 / 2n."""
        n, budget = self.model.total, self.ledger.budget
        gap, beliefs = {}, self.model.propagate()
        for part in batches_of(others, sizes):
            exact = _counted(coded, sizes, part)
            gap |= {m: float(np.abs(exact[m] - self.model.marginal(m, beliefs)).sum()) / 2 / n for m in part}
        if not self.noiseless and self.select == "exponential":
            # The largest scores with Gumbel noise are draws without replacement.
            mu = (self.plan.select_share * budget / max(1, self.plan.later)) ** 0.5
            self.ledger.spend("draws", take, 1.0, 1 / mu)
            gap = {m: g * n * dp.exponential_epsilon(mu) + rng.gumbel() for m, g in gap.items()}
        elif not self.noiseless:
            each = dp.noise_for(len(others), self.plan.select_share / rounds, budget)
            self.ledger.spend("distances", len(others), 1.0, each)
            gap = {m: g + rng.normal(0, each / 2 / n) for m, g in gap.items()}
        return sorted(others, key=lambda m: (-gap[m], m))[:take]

    def sample(self, spark: SparkSession, n: int | None = None) -> DataFrame:
        """row_id and the original values of n synthetic rows (as many as fitted)."""
        drawn = synthesis.synthesize(spark, self.model, n or self.rows, self.seed)
        return enc.decode(drawn, self.columns, [KEY], self.books)


@dataclass
class Message:
    """What a party sends: a model of its columns and its noisy number of rows; no row, and no count without noise."""

    party: str
    columns: list[str]
    sizes: dict[str, int]
    rows: float
    model: mrf.Model | None = None
    ledger: dp.Ledger | None = None


def agreed_rows(messages: list[Message]) -> float:
    """The number of rows that all parties go by from here on: the mean of their noisy ones."""
    return max(1.0, float(round(sum(m.rows for m in messages) / len(messages))))


def merged(messages: list[Message]) -> Message:
    """The parties' messages as one: columns side by side (none twice) and the agreed number of rows."""
    columns = [c for m in messages for c in m.columns]
    if len(set(columns)) < len(columns):
        raise ValueError("a column belongs to two parties")
    return Message("+".join(m.party for m in messages), columns, {c: d for m in messages for c, d in m.sizes.items()}, agreed_rows(messages))


def vertical(
    df: DataFrame, key: str, side_a: list[str], side_b: list[str], epsilon: float = 1.0, m: int = 256, method: str = "sketch", seed: int = 0, max_steps: int = 500, messages: list[Message] | None = None
) -> DataFrame:
    """A synthetic table of columns held by two parties.

    The parties agree on a noisy number of rows; each fits a model of its own
    columns; the pairs across come from sketches or from randomized response;
    the joint graph takes the most dependent of them, and rows are drawn from
    the joint model. messages, if given, gets what the parties sent.
    """
    spark = df.sparkSession
    columns = side_a + side_b
    books = enc.dictionaries(df, columns)
    coded = enc.encode(df, columns, [key], books).persist()
    sizes = dict(enc.domain_of(books).items())
    shares, rng = dp.Shares(), np.random.default_rng(seed)
    held_rows, scale = coded.count(), 1 / shares.count(epsilon)
    sent = [Message(name, side, {c: sizes[c] for c in side}, held_rows + rng.laplace(0, scale)) for name, side in (("a", side_a), ("b", side_b))]
    both = merged(sent)
    n = both.rows
    local = [Synthesizer(epsilon=shares.local(epsilon), seed=seed + k, max_steps=max_steps) for k in range(2)]
    for s, message in zip(local, sent):
        s.columns = message.columns
        s._fit(coded.select(*message.columns), Domain.of(message.sizes), n)
        message.model, message.ledger = s.model, s.ledger
    if messages is not None:
        messages += sent

    pairs = [(a, b) for a in side_a for b in side_b]
    across: dict[tuple, np.ndarray] = {}
    if method == "sketch":
        private = sketch.privacy(shares.sketch(epsilon, len(columns)), 1e-5, m, 1.0)
        sides = [sketch.privatize(sketch.complements(sketch.value_sketches(coded, key, side, m)), private, 1.0, seed) for side in (side_a, side_b)]
        cells = sketch.intersections(*sides, n, m, 1.0, private).toPandas()
        for a, b in pairs:
            t = np.zeros((sizes[a], sizes[b]))
            own = cells[(cells["attr_a"] == a) & (cells["attr_b"] == b)]
            t[own["value_a"].astype(int), own["value_b"].astype(int)] = own["value"]
            across[a, b] = t
    else:
        eps = shares.response(epsilon, len(columns))
        reports = local_dp.perturb_columns(coded, sizes, eps, key, seed)
        for a, b in pairs:
            two = {a: sizes[a], b: sizes[b]}
            cells = local_dp.clamp_and_scale(local_dp.unbias(mg.dense(reports, [a, b], Domain.of(two)), two, eps), n).toPandas()
            t = np.zeros((sizes[a], sizes[b]))
            t[cells[a], cells[b]] = cells["value"]
            across[a, b] = t

    def tvd(t: np.ndarray) -> float:
        total = max(t.sum(), 1.0)
        return float(np.abs(np.outer(t.sum(1), t.sum(0)) / total - t).sum() / 2 / total)

    ranked = sorted(pairs, key=lambda p: (-tvd(across[p]), p))
    graphs = [gr.Graph(side, {gr.Edge(e) for part in s.model.parts for e in combinations(part, 2)}) for s, side in zip(local, (side_a, side_b))]
    graph = gr.triangulate(gr.merge(*graphs, ranked, sizes))
    joint = mrf.Model.of(graph, sizes, float(n))
    held = {p: across[p] for p in pairs if gr.Edge(p) in graph.edges}
    for s in local:
        beliefs = s.model.propagate()
        held |= {part: s.model.marginal(part, beliefs) for part in s.model.parts}
    joint.fit(held, max_steps)
    drawn = synthesis.synthesize(spark, joint, int(n), seed)
    out = enc.decode(drawn, columns, [KEY], books)
    coded.unpersist()
    return out
