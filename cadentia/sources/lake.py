"""Date-partitioned decision lake and published feature snapshots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadentia.session import shuffles_dropped

# Days each kind of record is kept.
RETENTION_DAYS = {"session": 1, "decision": 30, "buffer": 180}
# Event that feeds adaptation, actions that raise an alert.
ADAPTATION_EVENT = "stepup.verified"
ALERT_ACTIONS = ("restrict", "block")


def adaptation_rule() -> Column:
    return F.col("event_type") == ADAPTATION_EVENT


def alert_rule() -> Column:
    return F.col("action").isin(*ALERT_ACTIONS)


def route_events(events: DataFrame, root: str, batch: int = 0) -> None:
    """Write ``events(event_type, action, ts, ...)`` to lake, adaptation and alerts.

    All events reach the lake, partitioned by date. The rebalance hint lets Spark
    give a busy date several files and several quiet dates one task. The other
    two targets read the batch back, so upstream runs once; only the folders of
    this batch are listed for that. Below the date every target is
    partitioned by ``batch``: writing a batch again replaces it, which makes a
    replay after a failure harmless.
    """
    dated = events.withColumn("date", F.to_date("ts")).withColumn("batch", F.lit(batch).cast("long"))

    def write(rows: DataFrame, target: str, parts: Sequence[str]) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts)
            .parquet(f"{root}/{target}")
        )

    write(dated.hint("rebalance", "date"), "lake", ["date", "batch"])
    spark = events.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/lake/date=*/batch={batch}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return  # an empty batch
    lake = spark.read.schema(dated.schema).option("basePath", f"{root}/lake")
    landed = lake.parquet(f"{root}/lake/date=*/batch={batch}")
    write(landed.where(adaptation_rule()), "adaptation", ["batch"])
    write(landed.where(alert_rule()), "alerts", ["batch"])


def scan_lake(
    spark: SparkSession,
    root: str,
    first: str | None = None,
    last: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read the lake between two dates inclusive; other partitions are not opened."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    lake = reader.parquet(f"{root}/lake")
    if first:
        lake = lake.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        lake = lake.where(F.col("date") <= F.lit(last).cast("date"))
    return lake


def retention(df: DataFrame, kind: str, as_of: dt.datetime | str, ts: str = "ts") -> DataFrame:
    """Rows not yet expired at ``as_of``; kinds are session, decision and buffer."""
    limit = F.lit(str(as_of)).cast("timestamp") - F.expr(f"INTERVAL {RETENTION_DAYS[kind]} DAYS")
    return df.where(F.col(ts) > limit)


def expire(spark: SparkSession, root: str, kind: str, as_of: dt.date | str) -> list[str]:
    """Delete the date partitions of ``{root}/lake`` whose every row has expired; returns their dates.

    A partition goes once its last moment is out of the kind's time; rows that expire
    within a partition that stays are hidden by :func:`retention`.
    """
    limit = dt.date.fromisoformat(str(as_of)[:10]) - dt.timedelta(days=RETENTION_DAYS[kind])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{root}/lake/date=*")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.globStatus(folder) or ():
        date = status.getPath().getName().removeprefix("date=")
        # Rows without a time have a partition of their own and do not expire.
        if date[:1].isdigit() and dt.date.fromisoformat(date) < limit:
            files.delete(status.getPath(), True)
            gone.append(date)
    return sorted(gone)


def publish_features(df: DataFrame, path: str, computed_at: str, keys: Sequence[str]) -> str:
    """Add one snapshot, stamped ``computed_at``; re-publishing replaces that snapshot only.

    Rows are hash-spread by key so that a lookup by key reads few files.
    """
    stamped = df.withColumn("computed_at", F.lit(computed_at).cast("timestamp")).withColumn(
        "snapshot", F.lit(computed_at)
    )
    with shuffles_dropped(df.sparkSession):
        (
            stamped.repartition(*keys)
            .sortWithinPartitions(*keys)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("snapshot")
            .parquet(path)
        )
    return path
