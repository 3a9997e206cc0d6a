"""The scan on newly arrived rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.scan import findings, scan_summary
from veilspark.rules import Rule
from veilspark.session import once


def scan_stream(
    stream: DataFrame,
    rules: Sequence[Rule],
    out: str,
    checkpoint: str,
    entropy: bool = True,
    trigger: dict | None = None,
    key: Sequence[str] = ("path",),
) -> StreamingQuery:
    """Scan a streaming corpus with the batch operators and write findings below ``out``.

    A text arrives whole in one micro-batch, so scanning needs no state across batches. Each batch owns the
    folder ``batch=<id>`` and overwrites it when it is run again after a failure: with the checkpoint, every
    finding is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = findings(batch, rules, entropy=entropy, ordered=False, key=key)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _last(seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """The newest batch of each key, and the hash of its text there."""
    newest = F.max(F.struct("batch", "sha256")).alias("newest")
    return seen.groupBy(*key).agg(newest).select(*key, "newest.batch", "newest.sha256")


def _seen(spark: SparkSession, out: str, key_schema: str) -> DataFrame:
    return spark.read.schema(f"{key_schema}, sha256 string, batch bigint").option("basePath", f"{out}/seen").parquet(f"{out}/seen")


def scan_changes(
    stream: DataFrame,
    rules: Sequence[Rule],
    out: str,
    checkpoint: str,
    version: str | None = None,
    entropy: bool = True,
    trigger: dict | None = None,
    key: Sequence[str] = ("path",),
) -> StreamingQuery:
    """``scan_stream`` with memory: a text that is delivered again is not scanned again, a changed one replaces its findings.

    The state is a table of keys and text hashes below ``out/seen``, one folder a batch, read as of the batches before:
    a batch that runs again after a failure sees the same state and overwrites its own folders. Findings are in
    ``out/findings``; :func:`current_findings` gives those of each text as it was last. Of several texts of one key in a batch
    the one of the greatest ``version`` counts (without one, that of the greatest hash). Only keys and hashes are
    joined with the state; null texts are texts without findings.
    """
    spark = stream.sparkSession
    key = list(key)
    key_schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in key)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/seen")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    order = F.col(version) if version else F.lit(0)

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        newest = F.max(F.struct(order.alias("version"), "sha256")).alias("newest")
        now = named.groupBy(*key).agg(newest).select(*key, F.col("newest.version").alias("version"), F.col("newest.sha256").alias("sha256"))
        before = _last(_seen(spark, out, key_schema).where(F.col("batch") < batch_id), key).withColumnRenamed("sha256", "known").drop("batch")
        changed = now.join(before, key, "left").where(~F.col("known").eqNullSafe(F.col("sha256"))).select(*key, "sha256")
        # Placed by a number that is given, as in ``by_key``: parts merged by their bytes are fewer than two for a core. The
        # join would slide below, so a column holds it.
        placed = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key, "sha256").withColumn("text", once(F.col("text")))
        texts = placed.join(changed, [*key, "sha256"], "left_semi").dropDuplicates([*key, "sha256"])
        findings(texts, rules, entropy=entropy, ordered=False, key=key).write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}")
        # The state comes last: it says that the findings of its keys are there.
        changed.write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_findings(spark: SparkSession, out: str, key: Sequence[str] = ("path",)) -> DataFrame:
    """The findings of each text as it was last delivered to :func:`scan_changes`."""
    found = spark.read.option("basePath", f"{out}/findings").parquet(f"{out}/findings")
    key_schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in key)
    last = _last(_seen(spark, out, key_schema), key).drop("sha256")
    return found.join(last, [*key, "batch"], "left_semi").select([c for c in found.columns if c != "batch"])


def current_summary(spark: SparkSession, out: str, key: Sequence[str] = ("path",)) -> DataFrame:
    """``scan_summary`` over all texts as they were last delivered."""
    found = current_findings(spark, out, key)
    key_schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in key)
    return scan_summary(_seen(spark, out, key_schema).select(*key).distinct(), found)
