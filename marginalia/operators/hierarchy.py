"""Attribute hierarchies: trees of codes, their levels, and tables moved between levels."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.encode import small


@dataclass
class Node:
    """A node holds values of its own and children; level 0 is the root's."""

    name: int
    values: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    @classmethod
    def from_json(cls, got: dict) -> Node:
        return cls(int(got["name"]), list(got["value_list"]), [cls.from_json(x) for x in got["node_list"]])

    def to_json(self, root: bool = True) -> dict:
        sizes = {str(k): v for k, v in self.level_sizes().items()} if root else None
        return {"name": self.name, "node_list": [c.to_json(False) for c in self.children], "value_list": self.values, "level_to_size": sizes}

    def leaves(self) -> list[str]:
        return self.values + [v for c in self.children for v in c.leaves()]

    def level_sizes(self) -> dict[int, int]:
        """Codes needed at each level: values met so far, and the nodes that stand for what lies below."""
        out, met, level, here = {}, 0, 0, [self]
        while here:
            met += sum(len(n.values) for n in here)
            below = [c for n in here for c in n.children]
            out[level] = met + len(below)
            level, here = level + 1, below
        return out

    def rows(self, attr: int | None = None) -> list[tuple[int, int, int | None, int, str | None]]:
        """(attr, node, parent, level, value) in a flat table; a node without values has one row without a value."""
        out, todo, number = [], [(self, None, 0)], 0
        while todo:
            node, parent, level = todo.pop(0)
            mine, number = number, number + 1
            out += [(attr if attr is not None else self.name, mine, parent, level, v) for v in node.values or [None]]
            todo += [(c, mine, level + 1) for c in node.children]
        return out


def one_level(names: list[int], sizes: list[int]) -> list[Node]:
    """All codes of each attribute at level 0."""
    return [Node(n, [str(v) for v in range(s)]) for n, s in zip(names, sizes)]


def to_table(spark: SparkSession, roots: list[Node]) -> DataFrame:
    return spark.createDataFrame([r for n in roots for r in n.rows()], "attr int, node int, parent int, level int, value string")


def read(text: str) -> list[Node]:
    return sorted((Node.from_json(x) for x in json.loads(text)), key=lambda n: n.name)


def dump(roots: list[Node]) -> str:
    return json.dumps([n.to_json() for n in roots])


def parse_domain_file(text: str) -> list[Node]:
    """The two kinds of lines: `C low high ...` is continuous (a root without values), `D { a b { c d } }` a tree of values."""
    roots = []
    for k, line in enumerate(x for x in text.splitlines() if x.strip()):
        tokens = re.findall(r"[{}]|[^\s{}]+", line)
        root = Node(k)
        if tokens[0] == "D":
            stack = [root]
            for t in tokens[2:-1]:
                if t == "{":
                    child = Node(k)
                    stack[-1].children.append(child)
                    stack.append(child)
                elif t == "}":
                    stack.pop()
                else:
                    stack[-1].values.append(t)
        elif tokens[0] != "C":
            raise ValueError(f"line {k + 1} starts with {tokens[0]}")
        roots.append(root)
    return roots


def split_values(values: list[str], runs: int, most: int, name: int) -> Node:
    """Values in runs of int(n / runs) + 1, and each run again while it has more than `most`."""
    if len(values) <= most:
        return Node(name, list(values))
    size = len(values) // runs + 1
    parts = [values[i : i + size] for i in range(0, len(values), size)]
    if len(parts) == 1:
        return Node(name, list(values))
    return Node(name, [], [split_values(p, runs, most, name) for p in parts])


def discretize(counts: list[tuple[str, float]], bins: int, smooth: float = 0.0, depth: int = 2, most: int = 1000, name: int = 0) -> Node:
    """A tree over a value histogram, in the order given: children of equal frequency (of equal width if smooth < 0).

    Each bin takes one value at least, so a heavy value moves the later bins on.
    """
    if depth == 0 or len(counts) <= max(1, most if depth == 2 else bins):
        return Node(name, [v for v, _ in counts])
    if smooth < 0:
        weights = [1.0] * len(counts)
    else:
        total = sum(c for _, c in counts)
        weights = [c + smooth * total for _, c in counts]
    whole, cum, groups, at = sum(weights), 0.0, [], -1
    for pair, w in zip(counts, weights):
        due = int(cum * bins / whole) if whole else 0
        if not groups or due > at:
            groups.append([])
            at = max(due, at + 1) if groups[:-1] else due
        groups[-1].append(pair)
        cum += w
    if len(groups) == 1:
        return Node(name, [v for v, _ in counts])
    return Node(name, [], [discretize(g, bins, smooth, depth - 1, most, name) for g in groups])


def coarse_table(spark: SparkSession, root: Node, level: int) -> DataFrame:
    """(value, coarse, sub, node_size): the code of each value at a level, and its place within the node that stands for it.

    Values met at the level or above keep a code each, with sub 0.
    """
    rows: list[tuple[int, int, int, int]] = []
    code, here, depth = 0, [root], 0
    while here:
        for n in here:
            for v in n.values:
                rows.append((int(v), code, 0, 1))
                code += 1
        below = [c for n in here for c in n.children]
        if depth == level:
            for c in below:
                leaves = c.leaves()
                rows += [(int(v), code, k, len(leaves)) for k, v in enumerate(leaves)]
                code += 1
            break
        here, depth = below, depth + 1
    return spark.createDataFrame(rows, "value int, coarse int, sub int, node_size int")


def roll_up(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """The column's codes replaced by the coarse ones, and a column <column>_sub beside it."""
    t = small(table.select(F.col("value").alias(column), F.col("coarse").alias("__coarse"), F.col("sub").alias(f"{column}_sub")))
    return df.join(t, column).drop(column).withColumnRenamed("__coarse", column)


def drill_down(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """The inverse of roll_up."""
    t = small(table.select(F.col("coarse").alias(column), F.col("sub").alias(f"{column}_sub"), F.col("value").alias("__value")))
    return df.join(t, [column, f"{column}_sub"]).drop(column, f"{column}_sub").withColumnRenamed("__value", column)


def structural_zeros(cells: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Cells whose sub-code the coarse node doesn't have are 0."""
    sizes = small(table.groupBy(F.col("coarse").alias(column)).agg(F.max("node_size").alias("__size")))
    return cells.join(sizes, column, "left").withColumn("value", F.when(F.col(f"{column}_sub") < F.coalesce("__size", F.lit(0)), F.col("value")).otherwise(F.lit(0).cast("double"))).drop("__size")


def level_sizes(table: DataFrame) -> DataFrame:
    """(attr, level, size) from the flat table: values met down to a level, and the nodes one level below."""
    values = table.groupBy("attr", "level").agg(F.count("value").alias("values"), F.countDistinct("node").alias("nodes"))
    w = Window.partitionBy("attr").orderBy("level")
    met = F.sum("values").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.select("attr", "level", (met + F.coalesce(F.lead("nodes").over(w), F.lit(0))).alias("size"))


def choose_levels(attrs: list[str], sizes: dict[str, dict[int, int]], limit: float, start: dict[str, int] | None = None) -> dict[str, int]:
    """Levels for a set of attributes: the coarsest, then finer ones while the product of sizes stays under the limit, the attribute that grows least first."""
    at = dict(start or {a: min(sizes[a]) for a in attrs})

    def cells(levels: dict[str, int]) -> float:
        out = 1.0
        for a in attrs:
            out *= sizes[a][levels[a]]
        return out

    while True:
        finer = [(sizes[a][at[a] + 1] / sizes[a][at[a]], a) for a in attrs if at[a] + 1 in sizes[a]]
        finer = [(g, a) for g, a in sorted(finer) if cells(at | {a: at[a] + 1}) <= limit]
        if not finer:
            return at
        at[finer[0][1]] += 1
