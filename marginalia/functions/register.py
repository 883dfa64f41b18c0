"""SQL functions of this package, for spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Scalar functions as SQL, so that they stay within generated code.
SCALARS = {
    "hash32": ("s STRING", "BIGINT", "cast(conv(substring(md5(s), 1, 8), 16, 10) as bigint)"),
    "geom_level": ("h BIGINT, gamma DOUBLE", "INT", "cast(ceil(ln((h + 1.0D) / 4294967296.0D) / ln(1.0D - gamma / (1.0D + gamma))) as int)"),
    "cut_code": ("x DOUBLE, low DOUBLE, high DOUBLE, bins INT", "INT", "if(high = low, 0, cast(least(bins - 1, greatest(0, ceil((x - low) / ((high - low) / bins)) - 1)) as int))"),
    "grr_debias": ("count DOUBLE, total DOUBLE, p DOUBLE, q DOUBLE, d INT", "DOUBLE", "(count - q / (p - q + d * q) * total) / (p - q)"),
}

#: A table function: all cells of a domain by their numbers.
DENSE_CELLS = """
    CREATE OR REPLACE TEMPORARY FUNCTION dense_cells(shape ARRAY<INT>)
    RETURNS TABLE (cell BIGINT)
    RETURN SELECT explode(sequence(0L, aggregate(shape, 1L, (a, x) -> a * x) - 1L))
"""


def register(spark: SparkSession) -> list[str]:
    """Register all functions for the session; their names."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.sql(DENSE_CELLS)
    return [*SCALARS, "dense_cells"]


def register_xxh32(spark: SparkSession) -> None:
    """xxh32(text, seed) over Arrow batches; only where the xxhash library is installed."""
    import pandas as pd
    import xxhash
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def xxh32(text, seed):
        return pd.Series([None if t is None else xxhash.xxh32_intdigest(t, int(s)) for t, s in zip(text, seed)], dtype="Int64")

    spark.udf.register("xxh32", pandas_udf(xxh32, "long", PandasUDFType.SCALAR))
