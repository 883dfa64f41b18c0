"""Properties of the operators, and known values."""

import json
import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import register
from marginalia.operators import consistency, evaluate, latent, local_dp, mrf, sketch, synthesis
from marginalia.operators import encode as enc
from marginalia.operators import graph as gr
from marginalia.operators import hierarchy as tree
from marginalia.operators import marginals as mg
from marginalia.operators import privacy as dp
from marginalia.operators import relations as rel
from marginalia.operators.domain import Domain, grid
from marginalia.operators.order import numbered
from marginalia.plans import synthesizer
from marginalia.plans.synthesizer import Synthesizer, vertical
from marginalia.sources import tables
from marginalia.streaming import sketches


@pytest.fixture(scope="module")
def hand(spark):
    """The table [[3, 1, 0], [1, 1, 2]]."""
    rows = [(a, b) for a, row in enumerate([[3, 1, 0], [1, 1, 2]]) for b, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_id long, a int, b int")


def test_domain():
    d = Domain.of({"x": 2, "y": 3, "z": 4})
    assert d.size == 24 and Domain.of({}).size == 1 and len(d) == 3 and d["y"] == 3 and d["q"] is None
    assert d.project(["z", "x"]).names == ("x", "z") and d.reorder(["z", "q", "x"]).names == ("z", "x")
    assert d.without(["y"]).names == ("x", "z") and d.union(Domain.of({"y": 3, "w": 5})).names == ("x", "y", "z", "w")
    assert d.positions(["z", "x"]) == [2, 0] and d.edges()[0] == [0, 1, 2] and Domain.from_json(d.to_json()) == d
    assert d.schema()["y"].metadata == {"domain": 3}


def test_known_scores(hand):
    assert mg.dependence(hand, "a", "b").first()[0] == pytest.approx(0.25)
    r = mg.pair_entropies(hand, [("a", "b")]).first()
    assert r["h_ab"] == pytest.approx(1.494175138289) and r["h_a"] == pytest.approx(0.693147180560) and r["h_b"] == pytest.approx(1.039720770840)
    assert r["mutual_information"] == pytest.approx(0.238692813111)
    assert mg.entropy(mg.sparse(hand, ["a", "b"])).first()[0] == pytest.approx(1.494175138289)


def test_dense_has_zero_cells_and_totals(hand):
    d = Domain.of({"a": 2, "b": 3})
    got = {(r["a"], r["b"]): r["value"] for r in mg.dense(hand, ["a", "b"], d).collect()}
    assert len(got) == 6 and got[0, 2] == 0 and sum(got.values()) == 8
    assert {(r["a"], r["b"]): r["value"] for r in mg.dense(hand, ["a", "b"]).collect()} == got
    assert grid(hand.sparkSession, d).count() == 6


def test_batch_agrees_with_single_marginals(hand):
    got = mg.batch(hand, [["a"], ["b"], ["a", "b"]]).collect()
    assert sum(r["value"] for r in got) == 24
    assert {r["a"]: r["value"] for r in got if r["set_id"] == 1} == {0: 4, 1: 4}


def test_equal_width_codes(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(12), 20]], "x double")
    got = [r["bin"] for r in enc.binned(df, "x", 4, []).orderBy("value").collect()]
    assert got == [0] * 6 + [1] * 5 + [2, 3]
    assert {r["bin"] for r in enc.binned(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 4, []).collect()} == {0}


def test_slack_codes_follow_their_rule(spark):
    r = random.Random(3)
    values = sorted({round(r.uniform(-50, 300), 2) for _ in range(300)})
    low, width, code, want = values[0], (values[-1] - values[0]) / 16, 0, {}
    for v in values:
        while v > low + (code + 1) * width + 1:
            code += 1
        want[v] = code
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert {x["value"]: x["bin"] for x in enc.binned(df, "x", 16, [], enc.slack_width).collect()} == want


def test_dictionary_round_trip_with_nulls(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, None), (4, "9")], "k int, v string")
    books = enc.dictionaries(df, ["v"])
    coded = enc.encode(df, ["v"], ["k"], books)
    assert {r["k"]: r["v"] for r in coded.collect()} == {1: 0, 2: 1, 3: None, 4: 1}
    assert {r["k"]: r["v"] for r in enc.decode(coded, ["v"], ["k"], books).collect()} == {1: "10", 2: "9", 3: None, 4: "9"}


def test_hierarchy(spark):
    root = tree.Node(0, ["7"], [tree.Node(0, ["1", "2"]), tree.Node(0, ["3"], [tree.Node(0, ["4", "5"])])])
    assert root.level_sizes() == {0: 3, 1: 5, 2: 6}
    assert tree.read(tree.dump([root]))[0].leaves() == root.leaves()
    got = {r["level"]: r["size"] for r in tree.level_sizes(tree.to_table(spark, [root])).collect()}
    assert got == root.level_sizes()
    table = tree.coarse_table(spark, root, 0)
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1, 2, 3, 4, 5, 7])], "k int, c int")
    assert {tuple(r) for r in tree.drill_down(tree.roll_up(df, "c", table), "c", table).select("k", "c").collect()} == {tuple(r) for r in df.collect()}
    parsed = tree.parse_domain_file("C 0 10\nD { a b { c d { e } } }\n")
    assert parsed[0].leaves() == [] and parsed[1].leaves() == ["a", "b", "c", "d", "e"] and parsed[1].level_sizes() == {0: 3, 1: 5, 2: 5}
    with pytest.raises(ValueError):
        tree.parse_domain_file("X 1")
    assert [len(c.values) for c in tree.split_values([str(k) for k in range(23)], 10, 10, 0).children] == [3] * 7 + [2]
    assert tree.choose_levels(["x", "y"], {"x": {0: 2, 1: 10}, "y": {0: 2, 1: 3}}, 25) == {"x": 0, "y": 1}
    made = tree.discretize([(str(k), 1.0) for k in range(2000)], 10)
    assert len(made.children) == 10 and made.leaves() == [str(k) for k in range(2000)]
    heavy = tree.discretize([("0", 1e6)] + [(str(k), 1.0) for k in range(1, 1500)], 10)
    assert heavy.leaves() == [str(k) for k in range(1500)]
    assert [n.leaves() for n in tree.one_level([3], [2])] == [["0", "1"]]


def test_factors(spark, hand):
    f = mg.sparse(hand, ["a", "b"]).withColumn("value", F.col("value").cast("double"))
    margin = mg.sum_out(f, ["a"])
    assert sorted(r["value"] for r in margin.collect()) == [4.0, 4.0]
    one = mg.product(mg.ratio(f, margin), margin)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in f.collect()}
    lse = mg.log_sum_exp(f.withColumn("value", F.log("value") + 800.0), [])
    assert lse.first()["value"] == pytest.approx(math.log(8) + 800)
    assert mg.inner(f, f, ["a", "b"]).first()[0] == 16.0
    empty = f.where("false")
    assert mg.sum_out(empty, ["a"]).count() == 0


def test_utility_of_itself_is_zero(hand):
    assert {round(r["tvd"], 12) for r in mg.utility(hand, hand, [["a"], ["a", "b"]]).collect()} == {0.0}
    assert len(evaluate.random_sets(["p", "q", "r"], 2, 50, 1)) == 3
    assert [r["tvd"] for r in evaluate.marginal_distance(hand, hand, ["a", "b"], (1, 2), 5).collect()] == pytest.approx([0, 0])


def test_response_is_undone_in_expectation(spark):
    p, q = local_dp.rates(1.0, 3)
    n = [3.0, 1.0, 4.0]
    seen = [sum((p if i == j else q) * n[j] for j in range(3)) for i in range(3)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(seen)], "a int, value double")
    assert [r["value"] for r in local_dp.unbias(df, {"a": 3}, 1.0).orderBy("a").collect()] == pytest.approx(n)


def test_known_two_axis_inverse(hand):
    cells = mg.dense(hand, ["a", "b"], Domain.of({"a": 2, "b": 3}))
    got = [r["value"] for r in local_dp.unbias(cells, {"a": 2, "b": 3}, 1.0).orderBy("a", "b").collect()]
    assert got == pytest.approx([9.106018, 0.418023, -5.524042, -2.778111, 0.418023, 6.360088], abs=1e-6)
    assert sum(r["value"] for r in local_dp.clamp_and_scale(local_dp.unbias(cells, {"a": 2, "b": 3}, 1.0), 8).collect()) == pytest.approx(8)


def test_response_keeps_with_chance_p(spark):
    df = spark.range(20000).select(F.col("id").alias("k"), F.lit(2).alias("c"))
    got = local_dp.perturb_columns(df, {"c": 5}, 1.0, "k", 1).groupBy("c").count().collect()
    p, q = local_dp.rates(1.0, 5)
    share = {r["c"]: r["count"] / 20000 for r in got}
    assert share[2] == pytest.approx(p, abs=0.02) and share[0] == pytest.approx(q, abs=0.02)


def test_sketches(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("a"), (F.col("id") % 4 < 2).cast("int").alias("b"), F.lit(1).alias("c"))
    m = 256
    one = sketch.complements(sketch.value_sketches(rows, "k", ["c"], m))
    assert {r["alpha"] for r in one.collect()} == {0}  # a value that all rows have
    h = {r["value"]: r["count"] for r in sketch.histogram(sketch.complements(sketch.value_sketches(rows, "k", ["a"], m)), 4000, m).collect()}
    assert h["0"] == pytest.approx(2000, rel=0.2) and sum(h.values()) == pytest.approx(4000)
    sides = [sketch.complements(sketch.value_sketches(rows, "k", [c], m)) for c in "ab"]
    cells = [r["value"] for r in sketch.intersections(*sides, 4000, m).collect()]
    assert len(cells) == 4 and sum(cells) == pytest.approx(4000)
    p = sketch.privacy(1.0, 1e-5, m, 1.0)
    assert p.phantoms > 0 and p.floor > 0 and sketch.privacy(0, 1e-5, m, 1.0) == sketch.Privacy()
    noisy = sketch.privatize(sides[0], p, 1.0, 1)
    assert noisy.agg(F.min("alpha")).first()[0] >= p.floor
    assert sketch.bias(2000) == pytest.approx(0.7209110685)


def test_stream_gives_the_same_sketches(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3).alias("a"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sketches.write(sketches.sketch_stream(stream, "k", ["a"], 4), "sketch_test", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("sketch_test").collect()} == {tuple(r) for r in sketch.value_sketches(rows, "k", ["a"], 4).collect()}


def test_budgets():
    for eps, want in ((0.8, 0.047823661006987095), (3.2, 0.5793221713975072), (0.11, 0.0012587381), (0.22, 0.0044807170), (0.23, 0.0048615567)):
        assert dp.gaussian_budget(eps) == pytest.approx(want, rel=1e-5)
    orders = list(range(1, 81))
    eps, _, best = dp.spent(orders, dp.rdp(1.0, 0.7, 2000, orders), delta=5e-4)
    assert eps == pytest.approx(4089.2335556) and best == 2
    assert dp.rdp(0.0, 1.0, 5, [2, 3]) == [0.0, 0.0] and dp.rdp(0.5, 0.0, 1, [2]) == [math.inf]
    whole, near = dp.rdp(0.1, 2.0, 1, [4.0]), dp.rdp(0.1, 2.0, 1, [3.999, 4.001])
    assert near[0] < whole[0] < near[1] and near[1] - near[0] < 1e-4
    assert dp.rdp_without_replacement(0.1, 4.0, 1, [2.5])[0] > dp.rdp(0.1, 4.0, 1, [2.5])[0]
    with pytest.raises(ValueError):
        dp.rdp_without_replacement(0.1, 4.0, 1, [1.5])
    assert dp.ledger_rdp([(1.0, [(1.0, 2.0)])], [3.0]) == pytest.approx([3 / 8])
    assert dp.log_sub(math.log(5), math.log(3)) == pytest.approx(math.log(2)) and dp.log_sub(1.0, 1.0) == -math.inf
    with pytest.raises(ValueError):
        dp.log_sub(0.0, 1.0)
    assert dp.log_erfc(40.0) == pytest.approx(-1604.2656, abs=1e-2)
    with pytest.raises(ValueError):
        dp.spent([2], [1.0])
    assert dp.tvd_sensitivity(10) == 0.2
    s = dp.Shares()
    assert s.local(0.8) == 0.16 and 1 - s.spent == pytest.approx(0.5)
    assert dp.gaussian_delta(0.3, dp.exponential_epsilon(0.3)) > 0 == pytest.approx(max(0.0, 1 / (1 + math.exp(-dp.exponential_epsilon(0.3))) - dp._phi(0.15)), abs=1e-12)


def test_exponential_mechanism_prefers_large_scores(spark):
    items = spark.createDataFrame([(k, float(k == 3) * 100) for k in range(10)], "k int, score double")
    assert dp.exponential_mechanism(items, "score", 5.0, 1.0, 1, "k").first()["k"] == 3
    assert dp.exponential_mechanism(items, "score", 5.0, 1.0, 1, "k", 4).count() == 4


def test_graph():
    g = gr.Graph(list("abcd"), {gr.Edge(e) for e in ("ab", "bc", "cd", "da")})
    t = gr.triangulate(g)
    assert len(t.edges) == 5 and sorted(map(len, gr.cliques(t))) == [3, 3]
    assert gr.cliques(gr.Graph(list("xyz"), set())) == [("x",), ("y",), ("z",)]
    parts = [("a", "b"), ("b", "c"), ("c", "d")]
    assert gr.junction_tree(parts) == [(0, 1), (1, 2)]
    order = gr.schedule([(0, 1), (1, 2)])
    assert len(order) == 4 and order.index((0, 1)) < order.index((1, 2))
    scores = {gr.Edge("ab"): 0.5, gr.Edge("bc"): 0.4, gr.Edge("ac"): 0.0}
    found = gr.search(list("abc"), scores, dict.fromkeys("abc", 2), 0.01)
    assert found.edges == {gr.Edge("ab"), gr.Edge("bc")}
    assert gr.subsets(found, 2) == [("a", "b"), ("b", "c")]
    assert {a for m in gr.network_measures(found, scores, dict.fromkeys("abc", 2), 100) for a in m} == set("abc")
    merged = gr.merge(gr.Graph(["a", "b"], set()), gr.Graph(["c", "d"], set()), [("a", "c"), ("b", "d")], dict.fromkeys("abcd", 2))
    assert gr.Edge("ac") in merged.edges and len(merged.edges) == 1
    assert gr.entropy_score(found, lambda c: float(len(c))) == -3.0


def test_model_is_exact_for_its_own_structure(spark, tmp_path):
    rng = np.random.default_rng(0)
    ab, bc = rng.random((2, 3)) + 0.1, rng.random((3, 2)) + 0.1
    joint = ab[:, :, None] * bc[None]
    joint *= 1000 / joint.sum()
    sizes = {"a": 2, "b": 3, "c": 2}
    model = mrf.Model.of(gr.Graph(list("abc"), {gr.Edge("ab"), gr.Edge("bc")}), sizes, 1000.0)
    losses = model.fit({("a", "b"): joint.sum(2), ("b", "c"): joint.sum(0)}, 2000)
    assert losses[-1] < 1e-3 * losses[0]
    assert model.marginal(("a", "b")) == pytest.approx(joint.sum(2), rel=1e-2)
    beliefs = model.propagate()
    assert beliefs[0].sum_to(("b",)).values == pytest.approx(beliefs[1].sum_to(("b",)).values)
    p = joint / 1000
    assert model.entropy() == pytest.approx(float(-(p * np.log(p)).sum()), rel=1e-2)
    with pytest.raises(KeyError):
        model.marginal(("a", "c"))
    model.save(spark, str(tmp_path / "model"))
    again = mrf.Model.load(spark, str(tmp_path / "model"))
    assert again.marginal(("b", "c")) == pytest.approx(model.marginal(("b", "c")))
    rows = synthesis.synthesize(spark, model, 500, 1)
    got = {(r["a"], r["b"]): r["count"] for r in rows.groupBy("a", "b").count().collect()}
    assert sum(got.values()) == 500
    for a, b in product(range(2), range(3)):
        assert got.get((a, b), 0) == pytest.approx(model.marginal(("a", "b"))[a, b] / 2, abs=3)
    assert set(mrf.candidates(model.parts, sizes)) == {("a",), ("b",), ("c",)}
    assert mrf.theoretic_loss([4, 6], 2.0) == 20.0


def test_allocation(spark):
    df = spark.createDataFrame([("x", 0.5), ("y", 0.3), ("z", 0.2)], "value string, prob double")
    got = [r["count"] for r in synthesis.allocate(df, F.lit(7), []).orderBy("value").collect()]
    assert got == [4, 2, 1]
    flat = df.withColumn("prob", F.lit(0.0))
    assert sum(r["count"] for r in synthesis.allocate(flat, F.lit(8), []).collect()) == 8


def test_numbers_of_large_groups(spark, monkeypatch):
    """In blocks, each row of a group has a number of its own, and columns drawn one after the other don't follow each other."""
    monkeypatch.setattr(synthesis, "BLOCK_ROWS", 100)
    rows = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 7 < 5).cast("int").alias("g"))
    got = synthesis.numbered_in_groups(rows, "row_id", ["g"], "1:x", 3000).collect()
    for g in (0, 1):
        own = [r["__row"] for r in got if r["g"] == g]
        assert sorted(own) == list(range(len(own)))
    half = spark.createDataFrame([(0, 0.5), (1, 0.5)], "x int, prob double")
    two = synthesis.add_column(rows, "row_id", half, [], "x", 1)
    two = synthesis.add_column(two, "row_id", half.withColumnRenamed("x", "y"), [], "y", 1)
    cells = {(r["x"], r["y"]): r["count"] for r in two.groupBy("x", "y").count().collect()}
    assert cells[0, 0] + cells[0, 1] == 1500 == cells[0, 0] + cells[1, 0] and cells[0, 0] == pytest.approx(750, abs=100)
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "(), row_number" not in plan
    assert synthesis.add_column(rows.where("false"), "row_id", half, [], "x", 1).count() == 0


def test_places_of_many_rows(spark):
    """The same places by ranges as by one task."""
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    whole = {r["k"]: r["at"] for r in numbered(df, [-F.col("k")], "at").collect()}
    ranges = numbered(df, [-F.col("k")], "at", few=10)
    assert {r["k"]: r["at"] for r in ranges.collect()} == whole and sorted(whole.values()) == list(range(1000)) and ranges.columns == ["k", "at"]


@pytest.mark.parametrize("select", ["distance", "exponential"])
def test_queries_made_are_within_the_budget(spark, monkeypatch, select):
    df = spark.createDataFrame([(k % 2, k % 3, k % 2, (k * 7 >> 2) % 4) for k in range(400)], "a int, b int, c int, d int")
    noisy, plain = [], synthesizer.measured_tables
    monkeypatch.setattr(synthesizer, "measured_tables", lambda coded, sizes, ms, sigma, seed: noisy.extend([sigma] * len(ms)) or plain(coded, sizes, ms, sigma, seed))
    s = Synthesizer(epsilon=3.2, select=select, max_steps=40).fit(df)
    assert 0 < len(noisy) <= s.plan.queries and set(noisy) == {s.plan.sigma}
    assert s.ledger.spent <= s.ledger.budget * (1 + 1e-9)
    # One number of rows, the scores of all pairs, every noisy table, and what selects them.
    asked = {what: sum(n for w, n, _ in s.ledger.entries if w == what) for what, _, _ in s.ledger.entries}
    assert asked["number of rows"] == 1 and asked["scores of pairs"] == 6 and asked["tables"] == len(noisy)
    assert asked.get("distances", 0) + asked.get("draws", 0) >= len(noisy) - s.plan.initial > 0
    assert sum(cost for _, _, cost in s.ledger.entries) == s.ledger.spent
    with pytest.raises(dp.OverBudget):
        s.ledger.spend("one more", 1, 1.0, s.plan.sigma / 10)
    assert abs(s.rows - 400) < 400 and len(s.entropies) >= 2


def test_parties_spend_their_shares(spark):
    rows = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("c"))
    sent = []
    made = vertical(rows, "row_id", ["a", "b"], ["c"], epsilon=4.0, m=32, max_steps=50, messages=sent)
    n = synthesizer.agreed_rows(sent)
    assert made.count() == n and len({m.rows for m in sent} | {600.0}) == 3 and abs(n - 600) < 60
    budget = dp.gaussian_budget(dp.Shares().local(4.0))
    assert all(m.ledger.budget == pytest.approx(budget) and m.ledger.spent <= budget * (1 + 1e-9) and "number of rows" not in dict.fromkeys(w for w, _, _ in m.ledger.entries) for m in sent)
    whole = synthesizer.merged(sent)
    assert whole.columns == ["a", "b", "c"] and whole.rows == n
    with pytest.raises(ValueError):
        synthesizer.merged([sent[0], sent[0]])
    for eps in (0.01, 0.3, 1.0, 4.0):
        s = dp.Shares()
        assert 0 < s.parties * s.local(eps) <= eps * s.local_model * (1 + 1e-9) and s.parties * s.count(eps) == pytest.approx(eps * s.row_count)


def test_relations(spark):
    ms = spark.createDataFrame([([0, 1],), ([1, 0],), ([0, 1, 2],), ([3],)], "measure array<int>")
    assert sorted(r["measure"] for r in rel.maximal(ms).collect()) == [[0, 1, 2], [3]]
    df = spark.range(103).withColumnRenamed("id", "k")
    sizes = {r["fold"]: r["count"] for r in rel.folds(df, "k", 1).groupBy("fold").count().collect()}
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert rel.split(df, "k", 1).where("train").count() == pytest.approx(82, abs=15)
    assert rel.row_sample(df, "k", 10, 1).count() == 10
    assert rel.top(df, "k", "k", 3).count() == 3
    late = spark.createDataFrame([("x", 1.0, 0), ("y", 1.5, 1), ("z", 2.5, 1)], "m string, w double, r int")
    assert [r["m"] for r in rel.top_late(late, "w", "m", 2, "r").collect()] == ["z", "x"]


def test_consistency(spark):
    one = spark.createDataFrame([(0, 0, 10.0), (0, 1, 10.0), (1, 0, 5.0), (1, 1, 15.0)], "a int, b int, value double")
    two = spark.createDataFrame([(0, 0, 16.0), (0, 1, 8.0), (1, 0, 6.0), (1, 1, 10.0)], "a int, c int, value double")
    out = consistency.enforce({"x": one, "y": two}, 40.0, 2)
    margins = [{r["a"]: r["value"] for r in mg.sum_out(t, ["a"]).collect()} for t in out.values()]
    assert margins[0] == pytest.approx(margins[1])


def test_latent_finds_a_common_cause(spark, tmp_path):
    r = random.Random(0)
    rows = []
    for k in range(400):
        z = k % 2
        rows.append((k, *[z if r.random() < 0.95 else 1 - z for _ in range(4)], -1 if k % 10 == 0 else z))
    cols = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "k int, a int, b int, c int, d int, e int")
    model = latent.fit(df, cols, "k", latent.Settings(hidden=1, rounds=12))
    label = {x["row_id"]: x["label"] for x in model.transform(df, cols, "k").collect()}
    agree = sum(label[k] == k % 2 for k in range(400)) / 400
    assert max(agree, 1 - agree) > 0.9 and model.history[-1] > 0.5
    model.save(str(tmp_path / "latent"))
    again = latent.Latent.load(spark, str(tmp_path / "latent"))
    assert again.settings == model.settings and {x["row_id"]: x["label"] for x in again.transform(df, cols, "k").collect()} == label


def test_registered_functions(spark):
    names = register.register(spark)
    assert "dense_cells" in names
    assert spark.sql("SELECT count(*) FROM dense_cells(array(2, 3))").first()[0] == 6
    assert spark.sql("SELECT cut_code(20D, 0D, 20D, 4)").first()[0] == 3
    register.register_xxh32(spark)
    import xxhash

    assert spark.sql("SELECT xxh32('abc', 7)").first()[0] == xxhash.xxh32_intdigest("abc", 7)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (2, 3)], "a int, b int")
    d = Domain.of({"a": 3, "b": 4})
    roots = tree.one_level([0, 1], [3, 4])
    tables.write_prepared(df, d, roots, {}, str(tmp_path), "t")
    back, domain, nodes = tables.read_prepared(spark, str(tmp_path), "t")
    assert sorted(map(tuple, back.collect())) == [(0, 1), (2, 3)] and domain == d and nodes[1].leaves() == ["0", "1", "2", "3"]
    (tmp_path / "x.dat").write_text("1 2 3\n4 5 6\n")
    assert [tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "x.dat")).collect()] == [("1", "2", "3"), ("4", "5", "6")]
    assert json.loads(tables.graph_json(["a", "b"], [("a", "b")]))["links"] == [{"source": "a", "target": "b"}]
    graph = gr.Graph(["b", "a", "c"], {gr.Edge("ab"), gr.Edge("ac")})
    tables.write_graph(spark, graph, str(tmp_path / "graph"))
    assert tables.read_graph(spark, str(tmp_path / "graph")) == graph
    tables.write_measures(spark, [("b",), ("a", "c")], str(tmp_path / "measures"))
    assert tables.read_measures(spark, str(tmp_path / "measures")) == [("b",), ("a", "c")]
    tables.log_entropies(spark, str(tmp_path / "log"), "t", 1.0, [3.0, 2.0])
    tables.log_entropies(spark, str(tmp_path / "log"), "t", 1.0, [2.5])
    assert sorted(tuple(r) for r in tables.read_entropies(spark, str(tmp_path / "log")).collect()) == [("t", 1.0, 0, 2.5), ("t", 1.0, 1, 2.0)]
    tables.append_results(df, str(tmp_path / "r"))
    tables.append_results(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4


def test_noiseless_synthesis_is_close(spark):
    rows = [(k, "abc"[k % 3], "xy"[(k % 3 == 0) or (k % 7 == 0)], k % 4) for k in range(1200)]
    df = spark.createDataFrame(rows, "k int, p string, q string, r int").drop("k")
    s = Synthesizer(noiseless=True, max_steps=300, seed=2).fit(df)
    made = s.sample(spark)
    assert made.count() == 1200
    distance = mg.utility(df.withColumn("r", F.col("r").cast("string")), made.select("p", "q", "r"), [["p", "q"], ["r"]]).agg(F.max("tvd")).first()[0]
    assert distance < 0.02


@pytest.mark.parametrize("method", ["sketch", "response"])
def test_vertical(spark, method):
    rows = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("c"))
    made = vertical(rows, "row_id", ["a", "b"], ["c"], epsilon=4.0, m=32, method=method, max_steps=100)
    assert made.count() == pytest.approx(600, abs=60) and set(made.columns) == {"row_id", "a", "b", "c"}


@pytest.mark.parametrize("method", ["forest", "svm"])
def test_misclassification(spark, method):
    df = spark.createDataFrame([(k % 2, k % 2, k % 3) for k in range(120)], "a int, b int, c int")
    assert evaluate.misclassification(df, df, ["a", "b", "c"], "a", method) == pytest.approx(0.0)


def test_kernel_machine_learns_what_no_line_divides(spark):
    r = random.Random(2)
    rows = [(x, y, int(x * x + y * y < 1.2)) for x, y in ((r.gauss(0, 1), r.gauss(0, 1)) for _ in range(600))]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    train, test = df.limit(400), df.subtract(df.limit(400))
    wrong = {m: evaluate.misclassification(train, test, ["a", "b", "c"], "c", m) for m in ("rbf", "svm")}
    assert wrong["rbf"] < 0.12 < 0.3 < wrong["svm"]


def test_cosines_stand_for_the_kernel(spark):
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(1).normal(0, 1, (20, 3))
    df = spark.createDataFrame([(k, Vectors.dense(v)) for k, v in enumerate(x)], ["k", "features"])
    z = np.array([r["features"].toArray() for r in evaluate.fourier_features(df, 3, 0, 4000).orderBy("k").collect()])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 3)
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_router(spark, hand):
    from marginalia.operators import router

    sizes = {"a": 2, "b": 3}
    model = mrf.Model.of(gr.Graph(["a"], set()), {"a": 2}, 8.0)
    reports = router.reassemble([local_dp.perturb_columns(hand, {c: d}, 50.0, "row_id", 1) for c, d in sizes.items()], "row_id")
    r = router.Router([({"a"}, model)], router.from_responses(reports, sizes, 50.0, 8), 8.0)
    assert r.marginal(("a",)) == pytest.approx([4, 4])
    assert r.marginal(("a", "b")) == pytest.approx(np.array([[3, 1, 0], [1, 1, 2]]), abs=1e-6)
    sides = [sketch.complements(sketch.value_sketches(hand, "row_id", [c], 16)) for c in "ab"]
    answer = router.from_sketches(sides, sizes, 8, 16)
    assert answer(("b", "a")).shape == (3, 2) and answer(("a", "b")).sum() == pytest.approx(8) and answer(("b",)).shape == (3,)
    assert router.independent([np.array([1.0, 3.0]), np.array([2.0, 2.0])], 8.0) == pytest.approx(np.array([[1, 1], [3, 3]]))


def test_experiment_and_cross_validation(spark):
    df = spark.createDataFrame([(k, k % 2, k % 2, k % 3) for k in range(90)], "k int, a int, b int, c int")
    got = evaluate.experiment(df, lambda e, r: df, ["a", "b", "c"], "t", (1.0,), 1, (2,), 3).collect()
    assert [(r["epsilon"], r["k"]) for r in got] == [(1.0, 2)] and got[0]["tvd"] == pytest.approx(0)
    assert evaluate.cross_validated(df, lambda train: train, ["a", "b", "c"], "a", "k", 2) == pytest.approx(0)


def test_information_beyond_chance(spark):
    df = spark.createDataFrame([(k, k % 2, (k * 7919 >> 3) % 3) for k in range(120)], "k int, a int, b int")
    rows = latent.long_rows(df, ["a", "b"], "k")
    post = df.select(F.col("k").alias("row_id"), F.lit(0).alias("factor"), F.posexplode(F.array(1.0 - F.col("a"), F.col("a") * 1.0)).alias("state", "p"))
    got = {r["attr"]: r["mi"] for r in latent.information_beyond_chance(rows, post, 5).collect()}
    assert got[0] > 0.5 and got[1] < 0.1


def test_exponential_selection(spark):
    df = spark.createDataFrame([(k % 2, k % 3, k % 2) for k in range(300)], "a int, b int, c int")
    assert Synthesizer(epsilon=4.0, select="exponential", max_steps=50).fit(df).sample(spark, 50).count() == 50
