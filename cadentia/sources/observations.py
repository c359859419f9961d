"""Reading repeated measurements, choosing feature columns, writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadentia.functions.scalars import q

# Prefixes of the timing columns (hold, down-down, up-down).
TIMING_PREFIXES = ("H.", "DD.", "UD.")


def timing_schema(timing_names: Sequence[str]) -> T.StructType:
    """Schema of a timing file: subject, session index, repetition, then timings."""
    keys = [
        T.StructField("subject", T.StringType()),
        T.StructField("sessionIndex", T.IntegerType()),
        T.StructField("rep", T.IntegerType()),
    ]
    return T.StructType(keys + [T.StructField(n, T.DoubleType()) for n in timing_names])


def read_observations(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "csv"
) -> DataFrame:
    """Read measurements; a missing path raises Spark's own PATH_NOT_FOUND.

    CSV needs a schema: inferring one would read the files twice. A header that
    names other columns and a cell that does not parse fail the job.
    """
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV needs an explicit schema")
        strict = {"header": True, "enforceSchema": False, "mode": "FAILFAST"}
        return spark.read.schema(schema).options(**strict).csv(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def feature_columns(df: DataFrame, prefixes: Sequence[str] = TIMING_PREFIXES) -> list[str]:
    """Names of the timing columns, in file order."""
    return [name for name in df.columns if name.startswith(tuple(prefixes))]


def select_features(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str] | None = None,
    prefixes: Sequence[str] = TIMING_PREFIXES,
) -> DataFrame:
    """Keys plus features as double; an empty choice means every timing column."""
    chosen = list(features or feature_columns(df, prefixes))
    return df.select(*[q(k) for k in keys], *[q(f).cast("double").alias(f) for f in chosen])


def pack_vector(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "features"
) -> DataFrame:
    """Keys plus one array of doubles in the order of ``features``."""
    cells = [q(f).cast("double") for f in features]
    return df.select(*[q(k) for k in keys], F.array(*cells).alias(name))


def unpack_vector(
    df: DataFrame, vector: str, width: int, prefix: str = "f", keep: Sequence[int] | None = None
) -> DataFrame:
    """Turn an array column into double columns ``f0, f1, ...``, or only those in ``keep``."""
    others = [q(c) for c in df.columns if c != vector]
    places = range(width) if keep is None else keep
    cells = [F.get(q(vector), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in places]
    return df.select(*others, *cells)


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()) -> str:
    """Write a result table, replacing an older one, and return the path."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_eer_table(comparison: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write ``subject, eer_mad, eer_std``."""
    return write_table(comparison.select("subject", "eer_mad", "eer_std"), path, fmt)
