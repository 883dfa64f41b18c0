"""Value sketches over a stream: they merge by maximum, so each micro-batch only raises levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from marginalia.operators import sketch


def sketch_stream(rows: DataFrame, key: str, attributes: list[str], m: int, gamma: float = 1.0) -> DataFrame:
    """(seed, attr, value, level) of a streaming table; state is one number for each seed and value."""
    return sketch.value_sketches(rows, key, attributes, m, gamma)


def write(sketches: DataFrame, name: str, checkpoint: str) -> DataStreamWriter:
    return sketches.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
