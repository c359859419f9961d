"""Token counts as delta-maintained rollups.

A ledger keeps additive totals of documents and tokens by source, language and tokenizer version.
Batches of signed rows (insert +1, delete -1; a revision is a delete of the old count and an insert
of the new one) are reduced to one row per group and committed under a batch id. A commit writes
the next version of the totals, which also lists the batches it contains, to a folder of its own,
and a version is valid only once Spark has marked it complete. Replaying a batch is a no-op,
so a driver that fails at any point repeats its last batch safely.

Scale: totals have one row per (source, lang, tokenizer), so a commit costs the batch's rows and never a
recount of the corpus. Deltas combine on the map side before they are shuffled; a hot source is one row per task.

Edge cases: null source, language and text are groups of their own and zero tokens. Repeated rows count
each time. A batch that deletes what was never inserted leaves negative totals, which ``open_groups`` shows. Groups
whose documents and tokens are all gone are dropped. An empty batch is committed as a batch without rows. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.tokens import token_ids
from cadentia.session import scratch_path

BLANK = " \t\r\n"
GROUP = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def token_counts(docs: DataFrame, vocabularies: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep``, ``tokenizer`` and ``tokens``: one row per row of ``docs`` and tokenizer version."""
    names = list(vocabularies)

    @F.pandas_udf("array<long>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array([len(token_ids(t, vocabularies[n])) for n in names]) for t in texts])

    rows = docs.select(*keep, counted("text").alias("n"))
    pairs = [F.struct(F.lit(n).alias("tokenizer"), F.get("n", F.lit(i)).alias("tokens")) for i, n in enumerate(names)]
    return rows.select(*keep, F.inline(F.array(*pairs)))


def signed(rows: DataFrame, sign: int | Column) -> DataFrame:
    """Rows of ``token_counts`` as deltas."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return rows.select(*GROUP, sign.cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace the old counts by the new ones."""
    return signed(old, -1).unionByName(signed(new, 1))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenLedger:
    """Totals in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _filesystem(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The latest complete version; 0 before any commit."""
        files, root = self._filesystem()
        if not files.exists(root):
            return 0
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in files.listStatus(root)]
        done = [int(n[1:]) for n in names if n[1:].isdigit() and files.exists(hadoop(f"{self.folder}/{n}/batches/_SUCCESS"))]
        return max(done, default=0)

    def totals(self) -> DataFrame:
        now = self.version()
        if not now:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.folder}/v{now}/totals")

    def batches(self) -> DataFrame:
        now = self.version()
        if not now:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/v{now}/batches")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas; False if it is already in the totals.

        The list of batches is written after the totals; its completion is the commit.
        """
        if self.batches().where(F.col("batch") == batch).count():
            return False
        target = f"{self.folder}/v{self.version() + 1}"
        added = _summed(self.totals().unionByName(deltas.select(*GROUP, "docs", "tokens")))
        kept = added.where("docs <> 0 OR tokens <> 0")
        kept.write.mode("overwrite").parquet(f"{target}/totals")
        one = self.spark.range(1).select(F.lit(batch).alias("batch"))
        self.batches().unionByName(one).coalesce(1).write.mode("overwrite").parquet(f"{target}/batches")
        return True

    def open_groups(self) -> DataFrame:
        """Groups with negative totals: deletes without their inserts."""
        return self.totals().where("docs < 0 OR tokens < 0")


def maintained_counts(docs: DataFrame, vocabularies: dict[str, str], arrivals: int = 4) -> DataFrame:
    """Totals of ``docs`` after a history of batches.

    All documents arrive in ``arrivals`` batches by doc_id. Then every document whose text another one
    with a smaller doc_id already holds is deleted, and the remaining copies' source keeps the rest. Last, documents
    with white space at the ends are revised to their trimmed text. The last batch is committed twice, to no effect.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ledger")
    text = F.coalesce("text", F.lit(""))
    trimmed = F.trim(text, F.lit(BLANK))
    keep = ["doc_id", "source", "lang", "group"]
    rows = docs.select("doc_id", "source", "lang", "text", F.sha2(text, 256).alias("group"))
    counts_path = f"{path}-counts"
    token_counts(rows, vocabularies, keep).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    ledger = TokenLedger(spark, path)
    arrival = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0))
    for number in range(arrivals):
        ledger.commit(f"arrival-{number}", signed(counts.where(arrival == number), 1))
    first = counts.groupBy("group").agg(F.min("doc_id").alias("first"))
    later = counts.join(first, "group").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    ledger.commit("copies", signed(later, -1))
    ragged = rows.where(trimmed != text)
    kept = ragged.join(first, "group").where(F.col("doc_id").eqNullSafe(F.col("first"))).drop("first")
    new = token_counts(kept.withColumn("text", F.trim("text", F.lit(BLANK))), vocabularies, keep)
    revision = revised(token_counts(kept, vocabularies, keep), new)
    ledger.commit("trimmed", revision)
    ledger.commit("trimmed", revision)
    return ledger.totals()
