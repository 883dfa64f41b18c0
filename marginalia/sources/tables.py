"""Reading and writing tables, schemas, models' inputs and results."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators import hierarchy
from marginalia.operators.domain import Domain
from marginalia.operators.graph import Edge, Graph


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text; the header names them unless columns does."""
    if columns is None:
        columns = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_codes(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = read_csv(spark, path, columns)
    return df.select(*[F.col(f"`{c}`").cast("int").alias(c) for c in df.columns])


def read_delimited(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """Lines without a header, split at the delimiter; columns are named by number."""
    df = spark.read.option("sep", delimiter).option("header", False).csv(path)
    return df.toDF(*map(str, range(len(df.columns))))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of metadata as one string."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_domain(spark: SparkSession, path: str) -> Domain:
    return Domain.from_json(read_text(spark, path))


def read_hierarchy(spark: SparkSession, path: str) -> list[hierarchy.Node]:
    return hierarchy.read(read_text(spark, path))


def write_hierarchy(spark: SparkSession, roots: list[hierarchy.Node], path: str) -> None:
    write_text(spark, hierarchy.dump(roots), path)


def read_prepared(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, Domain, list[hierarchy.Node]]:
    """The coded table with its domain and hierarchy, as written by write_prepared."""
    domain = read_domain(spark, f"{folder}/{name}.json")
    return read_codes(spark, f"{folder}/{name}.csv"), domain, read_hierarchy(spark, f"{folder}/{name}_hierarchy.json")


def write_prepared(coded: DataFrame, domain: Domain, roots: list[hierarchy.Node], books: dict[str, DataFrame], folder: str, name: str) -> None:
    spark = coded.sparkSession
    write_csv(coded.select(*domain.names), f"{folder}/{name}.csv")
    write_text(spark, domain.to_json(), f"{folder}/{name}.json")
    write_hierarchy(spark, roots, f"{folder}/{name}_hierarchy.json")
    for c, book in books.items():
        book.write.mode("overwrite").parquet(f"{folder}/{name}_dictionary/{c}")


def graph_json(nodes: list, edges: list[tuple]) -> str:
    return json.dumps({"nodes": [{"id": n} for n in nodes], "links": [{"source": a, "target": b} for a, b in edges]})


def write_graph(spark: SparkSession, graph: Graph, path: str) -> None:
    write_text(spark, graph_json(graph.nodes, [tuple(sorted(e, key=graph.nodes.index)) for e in sorted(graph.edges, key=sorted)]), path)


def read_graph(spark: SparkSession, path: str) -> Graph:
    got = json.loads(read_text(spark, path))
    return Graph([n["id"] for n in got["nodes"]], {Edge((e["source"], e["target"])) for e in got["links"]})


def write_measures(spark: SparkSession, measures: list[tuple], path: str) -> None:
    """One JSON line for each measure, with its place in the list."""
    rows = [(k, list(map(str, m))) for k, m in enumerate(measures)]
    spark.createDataFrame(rows, "place int, measure array<string>").coalesce(1).write.mode("overwrite").json(path)


def read_measures(spark: SparkSession, path: str) -> list[tuple]:
    return [tuple(r["measure"]) for r in spark.read.schema("place int, measure array<string>").json(path).orderBy("place").collect()]


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def log_entropies(spark: SparkSession, path: str, data: str, epsilon: float, entropies: list[float]) -> None:
    """Append a model's entropy after each step; of repeated keys `read_entropies` gives the last."""
    rows = [(data, float(epsilon), k, float(h), time.time_ns()) for k, h in enumerate(entropies)]
    append_results(spark.createDataFrame(rows, "data string, epsilon double, step int, entropy double, at long"), path)


def read_entropies(spark: SparkSession, path: str) -> DataFrame:
    from marginalia.operators.relations import latest

    return latest(spark.read.parquet(path), ["data", "epsilon", "step"], "at").drop("at")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without a setting only one machine has one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = found.get() if found.isDefined() else "/tmp/checkpoints/marginalia"
    return at


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that plans of loops stay short and survive a lost executor."""
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
