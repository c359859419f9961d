"""Checking landed files against a manifest of sizes and digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
# Stores that tasks open themselves; what else only Spark can read comes through Spark.
OPENED = ("file", "s3", "s3a", "gs", "hdfs")


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, file, bytes`` per file, from Spark's listing; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def empty_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, bytes, sha256`` of the files without content, which Spark's readers pass over."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{glob}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or ()
    names = [s.getPath().getName() for s in found if s.isFile() and s.getLen() == 0]
    rows = [(n, 0, hashlib.sha256(b"").hexdigest()) for n in names if n[0] not in "._"]
    return spark.createDataFrame(rows, "file string, bytes long, sha256 string")


def scheme(spark: SparkSession, path: str) -> str:
    """Which store a path lies in, as Spark resolves it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getScheme()


def digest_of(path: str, block: int = BLOCK) -> str:
    """SHA-256 of a file, read block by block."""
    address = path.replace("s3a://", "s3://", 1)
    if address.startswith("file:"):
        address = "/" + address.removeprefix("file:").lstrip("/")
    store, name = fs.FileSystem.from_uri(address) if ":" in address else (fs.LocalFileSystem(), address)
    digest = hashlib.sha256()
    with store.open_input_stream(name) as stream:
        while part := stream.read(block):
            digest.update(part)
    return digest.hexdigest()


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.assign(sha256=[digest_of(p) for p in part["path"]])


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file, bytes, sha256`` per file.

    Files of any size are streamed in blocks by the tasks that hash them, one file a task at a time. In a store that only
    Spark can open a file is read as one value, so there a file beyond 2 GB fails the job, with its name in the message.
    """
    if scheme(spark, path) in OPENED:
        tasks = max(1, spark.sparkContext.defaultParallelism)
        files = listed(spark, path, glob).repartition(tasks, "path")
        found = files.mapInPandas(_digests, "path string, file string, bytes long, sha256 string").drop("path")
    else:
        content = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        name = F.element_at(F.split("path", "/"), -1)
        found = content.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return found.unionByName(empty_files(spark, path, glob))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame, glob: str = "*") -> DataFrame:
    """Compare files with ``manifest(file, bytes, sha256)``.

    ``status`` is ok, missing, unexpected, size mismatch or checksum mismatch;
    the size is judged first because it names the usual failure, a cut-off copy.
    """
    found = file_digests(spark, path, glob)
    expected = manifest.select(
        "file", F.col("bytes").alias("expected_bytes"), F.col("sha256").alias("expected_sha256")
    )
    status = (
        F.when(F.col("bytes").isNull(), "missing")
        .when(F.col("expected_bytes").isNull(), "unexpected")
        .when(F.col("bytes") != F.col("expected_bytes"), "size mismatch")
        .when(F.col("sha256") != F.col("expected_sha256"), "checksum mismatch")
        .otherwise("ok")
    )
    return found.join(expected, "file", "full_outer").withColumn("status", status)
