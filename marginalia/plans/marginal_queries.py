"""Queries on encoding, hierarchies, marginals, factors and scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators import encode as enc
from marginalia.operators import hierarchy as tree
from marginalia.operators import marginals as mg
from marginalia.operators import relations as rel
from marginalia.operators.domain import Domain, decode_index, encode_index, grid
from marginalia.plans.registry import WIDE, query, uniform_sql
from marginalia.sources.tables import checkpoint_dir, read_codes, read_csv, read_delimited, read_prepared, table, write_csv, write_prepared

PARTY_A, PARTY_B = ["o_orderstatus", "o_orderpriority"], ["c_mktsegment", "c_nationkey"]


def party_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customers; the row's key is the order's."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", *PARTY_A)
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), *PARTY_B)
    return orders.join(customer, "o_custkey").drop("o_custkey")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Encoding


@query("""SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus,
                 CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders""")
def dictionary_encode(spark, sf):
    return enc.encode(table(spark, sf, "orders"), PARTY_A, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def dictionary_decode(spark, sf):
    orders = table(spark, sf, "orders")
    books = enc.dictionaries(orders, PARTY_A)
    return enc.decode(enc.encode(orders, PARTY_A, ["o_orderkey"], books), PARTY_A, ["o_orderkey"], books)


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
          SELECT o_orderkey, o_totalprice AS value, CAST(least(3, greatest(0, ceil((o_totalprice - lo) / ((hi - lo) / 4e0)) - 1)) AS INTEGER) AS bin FROM orders, e""")
def equal_width_bin(spark, sf):
    return enc.binned(table(spark, sf, "orders"), "o_totalprice", 4, ["o_orderkey"])


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
          SELECT c_custkey, c_acctbal AS value, CAST(greatest(0, ceil((c_acctbal - 1e0 - lo) / ((hi - lo) / 16e0)) - 1) AS INTEGER) AS bin FROM customer, e""")
def continuous_to_16_codes(spark, sf):
    return enc.binned(table(spark, sf, "customer"), "c_acctbal", 16, ["c_custkey"], enc.slack_width)


_SIZE_BINS = """e AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part),
    b AS (SELECT p_partkey, p_brand, p_size AS value, CAST(least(3, greatest(0, ceil((p_size - lo) / ((hi - lo) / 4e0)) - 1)) AS INTEGER) AS bin FROM part, e),
    c AS (SELECT bin, value, count(*) AS n FROM b GROUP BY bin, value),
    t AS (SELECT bin, value, n, n::DOUBLE / sum(n) OVER (PARTITION BY bin) AS prob,
                 (sum(n) OVER (PARTITION BY bin ORDER BY value) - n)::DOUBLE / sum(n) OVER (PARTITION BY bin) AS cum_lo,
                 sum(n) OVER (PARTITION BY bin ORDER BY value)::DOUBLE / sum(n) OVER (PARTITION BY bin) AS cum_hi FROM c)"""


def _size_bins(spark, sf):
    return enc.binned(table(spark, sf, "part"), "p_size", 4, ["p_partkey", "p_brand"])


@query(f"WITH {_SIZE_BINS} SELECT bin, value, n, round(prob, 9) AS prob, round(cum_lo, 9) AS cum_lo, round(cum_hi, 9) AS cum_hi FROM t")
def bin_conditional(spark, sf):
    return rounded(enc.conditional(_size_bins(spark, sf)), "prob", "cum_lo", "cum_hi", digits=9)


@query(f"""WITH {_SIZE_BINS}, u AS (SELECT p_partkey, bin, {uniform_sql("'7|' || p_partkey")} AS u FROM b)
           SELECT p_partkey, u.bin, t.value FROM u JOIN t ON u.bin = t.bin AND u >= cum_lo AND u < cum_hi""")
def unbin_hash(spark, sf):
    rows = _size_bins(spark, sf)
    return enc.unbin(rows.select("p_partkey", "bin"), enc.conditional(rows), ["p_partkey"], 7)


@query(f"""WITH {_SIZE_BINS}, m AS (SELECT bin, p_brand, count(*) AS v FROM b GROUP BY bin, p_brand)
           SELECT t.value AS p_size, p_brand, round(sum(v * prob), 6) AS value FROM m JOIN t ON m.bin = t.bin GROUP BY t.value, p_brand""")
def expand_binned_marginal(spark, sf):
    rows = _size_bins(spark, sf)
    marginal = mg.sparse(rows.withColumnRenamed("bin", "p_size"), ["p_size", "p_brand"])
    wide = enc.expand_bins(marginal.withColumn("value", F.col("value").cast("double")), {"p_size": enc.conditional(rows)})
    return rounded(mg.sum_out(wide, ["p_size", "p_brand"]), "value")


@query(f"""WITH n AS (SELECT p_size AS value, greatest(0e0, count(*) + (-2e0 * sign({uniform_sql("'3|' || p_size")} - 0.5e0) * ln(1e0 - 2e0 * abs({uniform_sql("'3|' || p_size")} - 0.5e0)))) AS noisy FROM part GROUP BY p_size),
           c AS (SELECT value, noisy, sum(noisy) OVER (ORDER BY value) AS cum, sum(noisy) OVER () AS total FROM n)
           SELECT value, CAST(least(4, greatest(0, ceil(round(cum * 5 / total, 9)) - 1)) AS INTEGER) AS bin, round(noisy, 6) AS noisy FROM c""")
def private_quantile_bins(spark, sf):
    return rounded(enc.private_quantile_bins(table(spark, sf, "part"), "p_size", 5, 2.0, 3), "noisy")


# Domain


@query("""SELECT cell, CAST(cell // 10 AS INTEGER) AS a, CAST((cell // 2) % 5 AS INTEGER) AS b, CAST(cell % 2 AS INTEGER) AS c, cell AS back FROM (SELECT unnest(range(30)) AS cell)""")
def mixed_radix_index(spark, sf):
    codes = decode_index(F.col("id"), [3, 5, 2])
    df = spark.range(30).select(F.col("id").alias("cell"), *[c.alias(n) for c, n in zip(codes, "abc")])
    return df.withColumn("back", encode_index([F.col("a"), F.col("b"), F.col("c")], [3, 5, 2]))


@query("""SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def domain_project(spark, sf):
    """The attributes that are kept, in the parent's order, and their distinct values."""
    d = Domain.of({"l_returnflag": 3, "l_linestatus": 2, "l_linenumber": 7}).project({"l_linestatus", "l_returnflag"})
    return table(spark, sf, "lineitem").select(*d.names).distinct()


@query("""SELECT a.n_name AS name, list_sort(list_distinct(list_concat(x, y))) AS both, list_sort(list_intersect(x, y)) AS common, list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS rest
          FROM (SELECT n_name, [n_nationkey, n_regionkey] AS x, [n_regionkey, 3] AS y FROM nation) a""")
def attribute_sets(spark, sf):
    x, y = F.array("n_nationkey", "n_regionkey"), F.array("n_regionkey", F.lit(3))
    nation = table(spark, sf, "nation")
    return nation.select(F.col("n_name").alias("name"), F.array_sort(F.array_union(x, y)).alias("both"), F.array_sort(F.array_intersect(x, y)).alias("common"), F.array_sort(F.array_except(x, y)).alias("rest"))


@query("SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY c_nationkey")
def value_lists(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))


@query("""SELECT event_id, nullif(CAST(floor(value) AS INTEGER), 5) AS x, CASE WHEN CAST(floor(value) AS INTEGER) = 5 THEN 0e0 ELSE 1e0 END AS counted FROM events WHERE value IS NOT NULL""")
def missing_mask(spark, sf):
    """A code stands for a missing value: null, and without weight."""
    x = F.floor("value").cast("int")
    return table(spark, sf, "events").where("value is not null").select("event_id", F.nullif(x, F.lit(5)).alias("x"), F.when(F.nullif(x, F.lit(5)).isNull(), 0.0).otherwise(1.0).alias("counted"))


# Hierarchy


def nation_tree(spark, sf) -> tree.Node:
    """Regions over nations; 25 rows of metadata."""
    got = table(spark, sf, "nation").select("n_regionkey", "n_nationkey").orderBy("n_regionkey", "n_nationkey").collect()
    return tree.Node(0, [], [tree.Node(0, [str(r["n_nationkey"]) for r in got if r["n_regionkey"] == k]) for k in sorted({r["n_regionkey"] for r in got})])


_COARSE = """g AS (SELECT n_nationkey, CAST(dense_rank() OVER (ORDER BY n_regionkey) - 1 AS INTEGER) AS coarse,
    CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS sub, count(*) OVER (PARTITION BY n_regionkey) AS node_size FROM nation)"""


@query(f"WITH {_COARSE} SELECT c_custkey, coarse AS c_nationkey, sub AS c_nationkey_sub FROM customer JOIN g ON c_nationkey = n_nationkey")
def hierarchy_rollup(spark, sf):
    coarse = tree.coarse_table(spark, nation_tree(spark, sf), 0)
    return tree.roll_up(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", coarse)


@query("SELECT c_custkey, c_nationkey FROM customer")
def hierarchy_drilldown(spark, sf):
    coarse = tree.coarse_table(spark, nation_tree(spark, sf), 0)
    return tree.drill_down(hierarchy_rollup(spark, sf), "c_nationkey", coarse)


@query("""SELECT 0 AS attr, 0 AS level, count(DISTINCT n_regionkey) AS size FROM nation UNION ALL SELECT 0, 1, count(*) FROM nation""")
def level_sizes(spark, sf):
    return tree.level_sizes(tree.to_table(spark, [nation_tree(spark, sf)]))


@query(f"""WITH {_COARSE}, s AS (SELECT coarse, max(node_size) AS k FROM g GROUP BY coarse)
           SELECT CAST(c AS INTEGER) AS region, CAST(u AS INTEGER) AS region_sub, CASE WHEN u < k THEN 1e0 ELSE 0e0 END AS value
           FROM (SELECT unnest(range(5)) AS c) CROSS JOIN (SELECT unnest(range(7)) AS u) JOIN s ON coarse = c""")
def structural_zeros(spark, sf):
    coarse = tree.coarse_table(spark, nation_tree(spark, sf), 0)
    cells = grid(spark, Domain.of({"region": 5, "region_sub": 7})).withColumn("value", F.lit(1.0))
    return tree.structural_zeros(cells, "region", coarse).select("region", "region_sub", "value")


@query("""SELECT p_size, CAST((row_number() OVER (ORDER BY p_size) - 1) // (count(*) OVER () // 10 + 1) AS INTEGER) AS run FROM (SELECT DISTINCT p_size FROM part)""")
def split_large_attribute(spark, sf):
    sizes = [str(r[0]) for r in table(spark, sf, "part").select("p_size").distinct().orderBy("p_size").collect()]
    root = tree.split_values(sizes, 10, 10, 0)
    rows = [(int(v), k) for k, c in enumerate(root.children or [root]) for v in c.leaves()]
    return spark.createDataFrame(rows, "p_size int, run int")


# Marginals


@query("SELECT l_returnflag, l_linestatus, count(*) AS value FROM lineitem GROUP BY ALL")
def sparse_marginal(spark, sf):
    return mg.sparse(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""WITH g AS (SELECT * FROM (SELECT DISTINCT l_returnflag FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) CROSS JOIN (SELECT DISTINCT l_discount FROM lineitem)),
          c AS (SELECT l_returnflag, l_linestatus, l_discount, count(*) AS n FROM lineitem GROUP BY ALL)
          SELECT l_returnflag, l_linestatus, l_discount, coalesce(n, 0) AS value FROM g LEFT JOIN c USING (l_returnflag, l_linestatus, l_discount)""")
def dense_marginal(spark, sf):
    return mg.dense(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_discount"])


@query("""SELECT grouping(l_returnflag, l_linestatus, l_linenumber, l_tax) AS set_id, l_returnflag, l_linestatus, l_linenumber, l_tax, count(*) AS value FROM lineitem
          GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, l_linenumber), (l_linestatus, l_tax), (l_linenumber, l_tax), (l_returnflag, l_linestatus, l_tax))""")
def marginal_batch_grouping_sets(spark, sf):
    sets = [["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linenumber"], ["l_linestatus", "l_tax"], ["l_linenumber", "l_tax"], ["l_returnflag", "l_linestatus", "l_tax"]]
    return mg.batch(table(spark, sf, "lineitem"), sets)


def _flag_status(spark, sf):
    return mg.sparse(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("value", F.col("value").cast("double"))


def _status_number(spark, sf):
    return mg.sparse(table(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber"]).withColumn("value", F.col("value").cast("double"))


_F1 = "f AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS x FROM lineitem GROUP BY ALL)"
_F2 = "g AS (SELECT l_linestatus, l_linenumber, count(*)::DOUBLE AS y FROM lineitem GROUP BY ALL)"


@query("SELECT l_returnflag, count(*)::DOUBLE AS value FROM lineitem GROUP BY ALL")
def marginalize_factor(spark, sf):
    return mg.sum_out(_flag_status(spark, sf), ["l_returnflag"])


@query(f"WITH {_F1}, {_F2} SELECT l_returnflag, f.l_linestatus, l_linenumber, x * y AS value FROM f JOIN g ON f.l_linestatus = g.l_linestatus")
def factor_product(spark, sf):
    return mg.product(_flag_status(spark, sf), _status_number(spark, sf))


@query(f"WITH {_F1}, h AS (SELECT l_linestatus, sum(x) AS z FROM f GROUP BY ALL) SELECT l_returnflag, f.l_linestatus, round(x / z, 9) AS value FROM f JOIN h ON f.l_linestatus = h.l_linestatus")
def factor_ratio(spark, sf):
    f = _flag_status(spark, sf)
    return rounded(mg.ratio(f, mg.sum_out(f, ["l_linestatus"])), "value", digits=9)


@query(f"WITH {_F1} SELECT l_linestatus, round(ln(sum(exp(ln(x) - 3e0))) + 3e0, 9) AS value FROM f GROUP BY ALL")
def factor_log_sum_exp(spark, sf):
    f = _flag_status(spark, sf).withColumn("value", F.log("value"))
    return rounded(mg.log_sum_exp(f, ["l_linestatus"]), "value", digits=9)


@query(f"WITH {_F1} SELECT sum(x * x) AS dot FROM f")
def potential_inner_product(spark, sf):
    f = _flag_status(spark, sf)
    return mg.inner(f, f, ["l_returnflag", "l_linestatus"])


@query(f"WITH {_F1}, {_F2}, d AS (SELECT l_linestatus, count(*)::DOUBLE AS z FROM lineitem GROUP BY ALL) SELECT l_returnflag, f.l_linestatus, x + z AS value FROM f JOIN d ON f.l_linestatus = d.l_linestatus")
def gradient_lift(spark, sf):
    """A measure's gradient added to every cell of its clique that lies over it."""
    return mg.add(_flag_status(spark, sf), mg.sum_out(_status_number(spark, sf), ["l_linestatus"]))


# Scores


@query(f"WITH {_F1}, t AS (SELECT sum(x) AS n FROM f) SELECT round(-sum(x / n * ln(x / n)), 9) AS entropy FROM f, t")
def entropy(spark, sf):
    return rounded(mg.entropy(_flag_status(spark, sf)), "entropy", digits=9)


def _entropy_sql(cols: str) -> str:
    return f"(SELECT -sum(x / n * ln(x / n)) FROM (SELECT count(*)::DOUBLE AS x, sum(count(*)) OVER ()::DOUBLE AS n FROM lineitem GROUP BY {cols}))"


@query("\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round({_entropy_sql(a)}, 9) AS h_a, round({_entropy_sql(b)}, 9) AS h_b, round({_entropy_sql(f'{a}, {b}')}, 9) AS h_ab, "
    f"round({_entropy_sql(a)} + {_entropy_sql(b)} - {_entropy_sql(f'{a}, {b}')}, 9) AS mutual_information"
    for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_tax"))
))
def mutual_information(spark, sf):
    pairs = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_tax")]
    return rounded(mg.pair_entropies(table(spark, sf, "lineitem"), pairs), "h_a", "h_b", "h_ab", "mutual_information", digits=9)


def _tvd_sql(a: str, b: str) -> str:
    return f"""(SELECT sum(abs(x.n * y.n / t.n - coalesce(j.n, 0))) / 2 / max(t.n)
        FROM (SELECT {a} AS a, count(*)::DOUBLE AS n FROM wide GROUP BY ALL) x CROSS JOIN (SELECT {b} AS b, count(*)::DOUBLE AS n FROM wide GROUP BY ALL) y
        CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM wide) t LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS n FROM wide GROUP BY ALL) j ON j.a = x.a AND j.b = y.b)"""


@query(f"WITH {WIDE} SELECT round({_tvd_sql('o_orderstatus', 'c_mktsegment')}, 9) AS tvd")
def tvd_score(spark, sf):
    return rounded(mg.dependence(party_wide(spark, sf), "o_orderstatus", "c_mktsegment"), "tvd", digits=9)


@query(f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS attr_a, '{b}' AS attr_b, round({_tvd_sql(a, b)}, 9) AS tvd" for a in PARTY_A for b in PARTY_B))
def cross_party_tvd_rank(spark, sf):
    """Flagship: how strongly each pair of attributes held by different parties depends, the strongest first."""
    return rounded(mg.cross_dependence(party_wide(spark, sf), PARTY_A, PARTY_B), "tvd", digits=9)


@query(f"""WITH {_F1}, a AS (SELECT l_returnflag, sum(x) AS p FROM f GROUP BY ALL), b AS (SELECT l_linestatus, sum(x) AS q FROM f GROUP BY ALL), t AS (SELECT sum(x) AS n FROM f)
           SELECT round(sum(abs(p * q / n - coalesce(x, 0))) / 2 / max(n), 9) AS l1 FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN f ON f.l_returnflag = a.l_returnflag AND f.l_linestatus = b.l_linestatus""")
def model_l1(spark, sf):
    """The independence model against the data."""
    f = _flag_status(spark, sf)
    n = f.agg(F.sum("value")).first()[0]
    model = mg.product(mg.sum_out(f, ["l_returnflag"]), mg.sum_out(f, ["l_linestatus"])).withColumn("value", F.col("value") / F.lit(n))
    return rounded(mg.l1(model, f, ["l_returnflag", "l_linestatus"], F.lit(n)), "l1", digits=9)


_SETS = [["l_returnflag", "l_linestatus", "l_tax"], ["l_returnflag", "l_linenumber", "l_discount"], ["l_linestatus", "l_linenumber", "l_tax", "l_discount"]]
_SET_COLUMNS = "l_returnflag, l_linestatus, l_tax, l_linenumber, l_discount"


@query(f"""WITH r AS (SELECT grouping({_SET_COLUMNS}) AS set_id, {_SET_COLUMNS}, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS w FROM lineitem
             GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in _SETS)})),
           m AS (SELECT grouping({_SET_COLUMNS}) AS set_id, {_SET_COLUMNS}, -(count(*)::DOUBLE / (SELECT count(*) FROM lineitem WHERE l_orderkey % 3 = 0)) AS w FROM lineitem WHERE l_orderkey % 3 = 0
             GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in _SETS)})),
           u AS (SELECT set_id, {_SET_COLUMNS}, sum(w) AS w FROM (SELECT * FROM r UNION ALL SELECT * FROM m) GROUP BY ALL)
           SELECT set_id, round(sum(abs(w)) / 2, 9) AS tvd FROM u GROUP BY set_id""")
def kway_tvd_utility(spark, sf):
    """3- and 4-way marginals of a third of the orders against all."""
    real = table(spark, sf, "lineitem")
    return rounded(mg.utility(real, real.where("l_orderkey % 3 = 0"), _SETS), "tvd", digits=9)


# Joins between parties


@query(f"WITH {WIDE} SELECT o_orderstatus, c_mktsegment, count(*) AS value FROM wide GROUP BY ALL")
def clean_intersection(spark, sf):
    a, b = rel.split_parties(party_wide(spark, sf), "row_id", [PARTY_A, PARTY_B])
    return rel.intersections([a, b], ["o_orderstatus", "c_mktsegment"], "row_id")


@query(f"WITH {WIDE} SELECT o_orderstatus, c_mktsegment, o_orderpriority, count(*) AS value FROM wide GROUP BY ALL")
def nway_intersection(spark, sf):
    parts = rel.split_parties(party_wide(spark, sf), "row_id", [["o_orderstatus"], ["c_mktsegment"], ["o_orderpriority"]])
    return rel.intersections(parts, ["o_orderstatus", "c_mktsegment", "o_orderpriority"], "row_id")


@query("SELECT o_orderpriority AS value, o_orderkey AS row_id FROM orders")
def membership_index(spark, sf):
    return rel.membership(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query(f"WITH {WIDE} SELECT row_id, o_orderstatus, o_orderpriority, c_mktsegment, c_nationkey FROM wide")
def positional_concat(spark, sf):
    """The parties' columns side by side again, by the row's key."""
    a, b = rel.split_parties(party_wide(spark, sf), "row_id", [PARTY_A, PARTY_B])
    return a.join(b, "row_id")


@query("""WITH s AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT chr(ascii(l_returnflag) + 1) AS l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
          SELECT r.l_returnflag, r.l_linenumber, r.n AS made, coalesce(s.n, 0) AS real FROM r LEFT JOIN s USING (l_returnflag, l_linenumber)""")
def sparse_lookup(spark, sf):
    """Cells of a table with other flags, as a synthetic one may have, probed in the true ones; missing counts are 0."""
    rows, cols = table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"]
    made = mg.sparse(rows.withColumn("l_returnflag", F.char(F.ascii("l_returnflag") + 1)), cols).withColumnRenamed("value", "made")
    real = mg.sparse(rows, cols).withColumnRenamed("value", "real")
    return made.join(real, cols, "left").withColumn("real", F.coalesce("real", F.lit(0)))


# Files: tables written to the shared folder and read back


def _new_path(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_text(spark, sf):
    """All columns of a CSV file as text."""
    at = _new_path(spark)
    write_csv(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), at)
    return read_csv(spark, at)


@query("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM customer")
def csv_codes(spark, sf):
    """The columns of a CSV file as codes."""
    at = _new_path(spark)
    write_csv(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), at)
    return read_codes(spark, at)


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS "0", r_name AS "1" FROM region""")
def delimited_lines(spark, sf):
    """Lines without a header, whose columns are named by number."""
    at = _new_path(spark)
    table(spark, sf, "region").select("r_regionkey", "r_name").write.option("sep", ";").csv(at)
    return read_delimited(spark, at, ";")


@query("""SELECT CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders""")
def prepared_table(spark, sf):
    """A coded table with its domain and hierarchy, as stored for later use."""
    at, orders = _new_path(spark), table(spark, sf, "orders")
    books = enc.dictionaries(orders, PARTY_A)
    domain = enc.domain_of(books)
    write_prepared(enc.encode(orders, PARTY_A, [], books), domain, tree.one_level([0, 1], list(domain.shape)), books, at, "orders")
    coded, found, roots = read_prepared(spark, at, "orders")
    assert found == domain and [len(r.leaves()) for r in roots] == list(domain.shape)
    return coded


@query("""SELECT 'l_returnflag' AS name, count(DISTINCT l_returnflag) AS size FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem
          UNION ALL SELECT 'cells', count(DISTINCT l_returnflag) * count(DISTINCT l_linenumber) FROM lineitem""")
def domain_sizes(spark, sf):
    """A domain of two columns, and the cells of their product."""
    d = enc.domain_of(enc.dictionaries(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"]))
    return spark.createDataFrame([*d.reorder(["l_returnflag", "l_linenumber"]).items(), ("cells", d.size)], "name string, size long")


@query("""SELECT l_returnflag, l_linestatus, greatest(0e0, count(*) - 15000e0) AS value FROM lineitem GROUP BY ALL""")
def clamp_negatives(spark, sf):
    f = _flag_status(spark, sf)
    return f.withColumn("value", F.greatest(F.lit(0.0), F.col("value") - 15000.0))


@query("SELECT o_orderstatus, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, max(o_totalprice) AS top, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
def argmax_and_mean(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.max("o_totalprice").alias("top"), F.round(F.avg("o_totalprice"), 4).alias("mean")
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, upper(trim(event_type)) || '-' || user_id AS label FROM events""")
def json_and_strings(spark, sf):
    got = F.from_json("props", "k int")
    return table(spark, sf, "events").select("event_id", got["k"].alias("k"), F.concat_ws("-", F.upper(F.trim("event_type")), F.col("user_id").cast("string")).alias("label"))


@query("""SELECT o_orderkey, round(ln(o_totalprice + 1), 6) AS log1p, round(sqrt(abs(o_totalprice)), 6) AS root, round_even(o_totalprice / 100, 0) AS half_even, CAST(ceil(o_totalprice) AS BIGINT) AS up FROM orders""")
def scalar_math(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(F.log1p("o_totalprice"), 6).alias("log1p"), F.round(F.sqrt(F.abs("o_totalprice")), 6).alias("root"),
        F.bround(F.col("o_totalprice") / 100, 0).alias("half_even"), F.ceil("o_totalprice").alias("up"),
    )


@query("""SELECT c_nationkey, c_custkey, CAST(sum(1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS running FROM customer""")
def running_count(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.count("*").over(w).alias("running"))
