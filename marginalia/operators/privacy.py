"""Noise mechanisms over tables, and the accounting of what they cost."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.hashing import gumbel, laplace, normal


def gaussian_mechanism(cells: DataFrame, keys: list[str], sigma: float, seed: int, clamp: bool = False) -> DataFrame:
    noisy = F.col("value") + F.lit(float(sigma)) * normal(F.lit(seed), *[F.col(k) for k in keys])
    return cells.withColumn("value", F.greatest(F.lit(0.0), noisy) if clamp else noisy)


def laplace_mechanism(cells: DataFrame, keys: list[str], scale: float, seed: int, clamp: bool = False) -> DataFrame:
    """Independent noise for each cell."""
    noisy = F.col("value") + laplace(scale, F.lit(seed), *[F.col(k) for k in keys])
    return cells.withColumn("value", F.greatest(F.lit(0.0), noisy) if clamp else noisy)


def exponential_mechanism(items: DataFrame, score: str, epsilon: float, sensitivity: float, seed: int, key: str, k: int = 1) -> DataFrame:
    """k items without replacement, each with a chance of exp(score epsilon / 2 sensitivity): the largest Gumbel-noised scores."""
    noisy = F.col(score) * F.lit(epsilon / (2 * sensitivity)) + gumbel(F.lit(seed), F.col(key))
    return items.withColumn("noisy", noisy).orderBy(F.desc("noisy"), key).limit(k)


def smoothed(cells: DataFrame, keys: list[str], width: float, sigma: float, seed: int) -> DataFrame:
    """Cells of a similar noisy size share one noisy mean; groups are `width` wide.

    Two Gaussian queries at sigma: the table by which cells are grouped, and
    the means (which one row changes by 1 at most). Nothing else of the counts
    shows, not even which of them are equal.
    """
    from marginalia.operators.encode import small

    place = F.col("value") + F.lit(float(sigma)) * normal(F.lit(seed), F.lit("group"), *[F.col(k) for k in keys])
    grouped = cells.withColumn("group", F.floor(place / F.lit(float(width))))
    means = grouped.groupBy("group").agg(F.avg("value").alias("mean"))
    noisy = means.withColumn("shared", F.col("mean") + F.lit(float(sigma)) * normal(F.lit(seed), F.col("group")))
    return grouped.join(small(noisy), "group").drop("value", "mean", "group").withColumnRenamed("shared", "value")


def sanitized_histogram(counts: DataFrame, keys: list[str], epsilon: float, n: float, seed: int) -> DataFrame:
    """A one-way histogram with Laplace noise for epsilon, clamped at 0 and scaled to n rows (evenly if nothing is left)."""
    noisy = laplace_mechanism(counts, keys, 1.0 / epsilon, seed, clamp=True)
    both = noisy.agg(F.struct(F.sum("value").alias("sum"), F.count("*").alias("cells"))).scalar()
    scaled = F.when(both["sum"] > 0, F.col("value") * F.lit(float(n)) / both["sum"]).otherwise(F.lit(float(n)) / both["cells"])
    return noisy.withColumn("value", scaled)


def tvd_sensitivity(n: float) -> float:
    return 2 / n


# The Gaussian budget


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def gaussian_delta(mu: float, epsilon: float) -> float:
    """The delta of a Gaussian mechanism whose sensitivity over noise is mu."""
    if mu <= 0:
        return 0.0
    return _phi(mu / 2 - epsilon / mu) - math.exp(epsilon) * _phi(-mu / 2 - epsilon / mu)


def gaussian_budget(epsilon: float, delta: float = 1e-5) -> float:
    """The largest mu squared whose mechanism is (epsilon, delta) private; noise of k queries at a share b of it is sqrt(k / (b mu^2))."""
    low, high = 0.0, 1.0
    while gaussian_delta(high, epsilon) < delta:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gaussian_delta(mid, epsilon) < delta else (low, mid)
    return ((low + high) / 2) ** 2


def noise_for(queries: float, share: float, budget: float) -> float:
    return math.sqrt(queries / (share * budget))


def exponential_epsilon(mu: float) -> float:
    """The epsilon of a pure mechanism that is as private as a Gaussian one whose sensitivity over noise is mu."""
    return math.log(_phi(mu / 2) / _phi(-mu / 2))


class OverBudget(ValueError):
    """A query that the budget doesn't cover."""


@dataclass
class Ledger:
    """What has been asked, in units of the Gaussian budget: the squared sensitivity over noise of each query.

    Squares of Gaussian mechanisms add up, so the whole is as private as one
    query at the sum; no entry is made that would pass the budget.
    """

    budget: float
    entries: list[tuple[str, int, float]] = field(default_factory=list)

    @property
    def spent(self) -> float:
        return sum(cost for _, _, cost in self.entries)

    def spend(self, what: str, queries: int, sensitivity: float, sigma: float) -> None:
        cost = queries * (sensitivity / sigma) ** 2
        if self.spent + cost > self.budget * (1 + 1e-9):
            raise OverBudget(f"{what}: {cost} over {self.budget - self.spent}")
        self.entries.append((what, queries, cost))


@dataclass(frozen=True)
class Shares:
    """What part of a party's epsilon goes where."""

    local_model: float = 0.4
    binning: float = 0.2
    row_count: float = 0.1
    parties: int = 2
    binned: bool = False

    @property
    def spent(self) -> float:
        return self.local_model + self.row_count + (self.binning if self.binned else 0)

    def local(self, epsilon: float) -> float:
        """Of each party's model, to two digits where that leaves something and isn't more."""
        whole = epsilon * self.local_model / self.parties
        return r if 0 < (r := round(whole, 2)) <= whole * (1 + 1e-9) else whole

    def count(self, epsilon: float) -> float:
        """Of each party's noisy number of rows."""
        return epsilon * self.row_count / self.parties

    def sketch(self, epsilon: float, attributes: int) -> float:
        """For each attribute, by advanced composition."""
        return epsilon * (1 - self.spent) / math.sqrt(attributes)

    def response(self, epsilon: float, attributes: int) -> float:
        return 2 * epsilon * (1 - self.spent) / attributes


@dataclass(frozen=True)
class ModelNoise:
    """Standard deviations and size limits of one model's queries."""

    initial: int
    attributes: int
    budget: float
    n: float
    graph_share: float = 0.10
    select_share: float = 0.10
    step_share: float = 0.8
    theta: float = 6.0
    #: Of the number of rows; 0 if it is known from elsewhere.
    count_share: float = 0.0

    @property
    def later(self) -> int:
        """Tables that may be measured after the first ones."""
        return int(self.step_share * self.attributes)

    @property
    def queries(self) -> int:
        return self.initial + self.later

    @property
    def sigma(self) -> float:
        return noise_for(self.queries, 1 - self.graph_share - self.select_share - self.count_share, self.budget)

    @property
    def cell_limit(self) -> float:
        """Tables with more cells than this have more noise than content."""
        return self.n / (self.sigma * math.sqrt(2 / math.pi)) / self.theta

    @property
    def steps(self) -> int:
        return max(1, min(self.attributes, 12))


# Renyi accounting


def log_add(x: float, y: float) -> float:
    if math.inf in (x, y):
        return math.inf
    low, high = min(x, y), max(x, y)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def log_sub(x: float, y: float) -> float:
    """log(exp x - exp y)."""
    if x < y:
        raise ValueError("the difference would be negative")
    if y == -math.inf:
        return x
    return -math.inf if x == y else x + math.log1p(-math.exp(y - x))


def log_erfc(x: float) -> float:
    value = math.erfc(x)
    if value > 0:
        return math.log(value)
    # The asymptotic series, where erfc underflows.
    s = 1 - 1 / (2 * x**2) + 3 / (4 * x**4) - 15 / (8 * x**6) + 105 / (16 * x**8)
    return -math.log(math.pi) / 2 - math.log(x) - x * x + math.log(s)


def _log_binomial(a: float, k: int) -> float:
    return math.lgamma(a + 1) - math.lgamma(k + 1) - math.lgamma(a - k + 1)


def _log_moment(q: float, sigma: float, alpha: float) -> float:
    """log of the alpha-th moment of a Poisson-sampled Gaussian."""
    if float(alpha).is_integer():
        total = -math.inf
        for k in range(int(alpha) + 1):
            total = log_add(total, _log_binomial(alpha, k) + k * math.log(q) + (alpha - k) * math.log1p(-q) + (k * k - k) / (2 * sigma**2))
        return total
    return _log_moment_by_quadrature(q, sigma, alpha)


def _log_moment_by_quadrature(q: float, sigma: float, alpha: float, cells: int = 4000) -> float:
    """log E[(1 - q + q exp((2x - 1) / 2 sigma^2))^alpha] for x ~ N(0, sigma^2), by Simpson's rule in log space.

    The integrand is a Gaussian around 0 where the first term of the sum
    rules, and one around alpha where the second does; beyond twelve standard
    deviations of both lies less than 1e-30 of it.
    """
    low, high = -12 * sigma, alpha + 12 * sigma
    cells = 2 * max(cells, math.ceil((high - low) / sigma * 20))
    step, terms = (high - low) / cells, []
    for i in range(cells + 1):
        x = low + i * step
        ratio = log_add(math.log1p(-q), math.log(q) + (2 * x - 1) / (2 * sigma**2))
        weight = 1 if i in (0, cells) else 4 if i % 2 else 2
        terms.append(math.log(weight * step / 3) + alpha * ratio - x * x / (2 * sigma**2) - math.log(sigma * math.sqrt(2 * math.pi)))
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def rdp(q: float, sigma: float, steps: int, orders: list[float]) -> list[float]:
    """Renyi divergences of a Poisson-sampled Gaussian at each order."""

    def one(alpha: float) -> float:
        if q == 0:
            return 0.0
        if sigma == 0 or math.isinf(alpha):
            return math.inf
        if q == 1:
            return alpha / (2 * sigma**2)
        return _log_moment(q, sigma, alpha) / (alpha - 1)

    return [steps * one(a) for a in orders]


def rdp_without_replacement(q: float, sigma: float, steps: int, orders: list[float]) -> list[float]:
    """The bound for samples of a fixed size; between whole orders the cumulant is interpolated."""

    def whole(alpha: int) -> float:
        if q in (0, 1):
            return 0.0 if q == 0 else alpha / (2 * sigma**2)
        def moment(j: int) -> float:
            return (j - 1) * j / (2 * sigma**2)

        total = 0.0
        for j in range(2, alpha + 1):
            if j == 2:
                least = min(math.log(4) + math.log(math.expm1(min(1 / sigma**2, 700.0))), math.log(2) + 1 / sigma**2)
            else:
                least = math.log(2) + moment(j)
            total = log_add(total, _log_binomial(alpha, j) + j * math.log(q) + least)
        return min(total / (alpha - 1), alpha / (2 * sigma**2))

    def one(alpha: float) -> float:
        if alpha < 2:
            raise ValueError("orders start at 2")
        if math.isinf(alpha):
            return math.inf
        low, high = math.floor(alpha), math.ceil(alpha)
        if low == high:
            return whole(low)
        t = alpha - low
        return ((1 - t) * (low - 1) * whole(low) + t * (high - 1) * whole(high)) / (alpha - 1)

    return [steps * one(a) for a in orders]


def spent(orders: list[float], values: list[float], epsilon: float | None = None, delta: float | None = None) -> tuple[float, float, float]:
    """(epsilon, delta, best order); exactly one of the two is given."""
    if (epsilon is None) == (delta is None):
        raise ValueError("give epsilon or delta")
    if epsilon is None:
        best = min(((r - math.log(delta) / (a - 1), a) for a, r in zip(orders, values) if not math.isnan(r) and a > 1), default=(math.inf, math.nan))
        return best[0], delta, best[1]
    best = min(((math.exp(min(0.0, (a - 1) * (r - epsilon))), a) for a, r in zip(orders, values) if not math.isnan(r) and a > 1), default=(1.0, math.nan))
    return epsilon, best[0], best[1]


def ledger_rdp(ledger: list[tuple[float, list[tuple[float, float]]]], orders: list[float]) -> list[float]:
    """Of samples (q, [(norm bound, noise)]): the queries of a sample act as one of the joint noise."""
    total = [0.0] * len(orders)
    for q, queries in ledger:
        effective = sum((noise / bound) ** -2 for bound, noise in queries) ** -0.5
        total = [t + r for t, r in zip(total, rdp(q, effective, 1, orders))]
    return total


def rdp_table(spark: SparkSession, q: float, sigma: float, steps: int, largest: int) -> DataFrame:
    """(alpha, rdp) of whole orders 2 to largest, as a plan: terms of the binomial sum, added in log space."""
    orders = spark.range(2, largest + 1).select(F.col("id").cast("int").alias("alpha"))
    terms = orders.select("alpha", F.explode(F.sequence(F.lit(0), F.col("alpha"))).alias("k"))
    choose = _log_factorial("alpha") - _log_factorial("k") - _log_factorial("alpha - k")
    log_term = choose + F.col("k") * F.lit(math.log(q)) + (F.col("alpha") - F.col("k")) * F.lit(math.log1p(-q)) + (F.col("k") * F.col("k") - F.col("k")) / F.lit(2 * sigma**2)
    top = terms.withColumn("t", log_term)
    most = top.groupBy("alpha").agg(F.max("t").alias("m"))
    summed = top.join(F.broadcast(most), "alpha").groupBy("alpha").agg((F.max("m") + F.log(F.sum(F.exp(F.col("t") - F.col("m"))))).alias("log_a"))
    return summed.select("alpha", (F.lit(float(steps)) * F.col("log_a") / (F.col("alpha") - 1)).alias("rdp"))


def _log_factorial(n: str):
    return F.expr(f"aggregate(sequence(0, cast({n} as int)), 0.0D, (s, x) -> s + if(x > 0, ln(cast(x as double)), 0.0D))")
