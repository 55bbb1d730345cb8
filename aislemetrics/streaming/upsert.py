"""Upsert sink for update-mode streams, and the rows that come too late for it.

A micro-batch writes the rows it changed into a folder that is named by its batch id and overwritten
if the batch runs again, so a replayed batch changes nothing. The table is the last version of each
key; ``fold`` writes the versions of finished batches as one, so that reads stay short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import path_exists, remove_path

FOLDED = "folded"


def upsert_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """What ``foreachBatch`` calls: the changed rows of one micro-batch, the same whenever it runs."""
    rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")


def run_upserts(stream: DataFrame, path: str) -> None:
    """Process all data present in update mode into the table at ``path``."""
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda rows, batch_id: upsert_batch(rows, batch_id, path)).start().awaitTermination()


def _versions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    numbered = StructType([*schema.fields]).add("batch", "long")
    parts = []
    for name in ("changes", FOLDED):
        if path_exists(spark, f"{path}/{name}"):
            parts.append(spark.read.schema(numbered).parquet(f"{path}/{name}"))
    if not parts:
        return spark.createDataFrame([], numbered)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def current(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The last version of each key."""
    rest = [f.name for f in schema.fields if f.name not in keys]
    last = _versions(spark, path, schema).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*[c if c in keys else F.col("_last")[c].alias(c) for c in schema.fieldNames()])


def fold(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], upto: int) -> None:
    """Put the versions of the batches up to ``upto`` together. Only finished batches may be folded.

    The folded rows carry their batch, and are written before the batches go: a reader between the two
    steps meets the same version twice.
    """
    rest = [f.name for f in schema.fields if f.name not in keys]
    kept = _versions(spark, path, schema).where(F.col("batch") <= upto).groupBy(*keys)
    kept = kept.agg(F.max_by(F.struct(*rest), "batch").alias("_last"), F.max("batch").alias("batch")).select(*keys, "_last.*", "batch")
    kept.write.mode("overwrite").parquet(f"{path}/next")
    spark.read.schema(kept.schema).parquet(f"{path}/next").write.mode("overwrite").parquet(f"{path}/{FOLDED}")
    for batch in range(upto + 1):
        remove_path(spark, f"{path}/changes/batch={batch}")
    remove_path(spark, f"{path}/next")


def late_batch(rows: DataFrame, batch_id: int, path: str, ends: Column, late: str, ts: str = "ts") -> None:
    """Write the rows of a micro-batch whose window had ended, by ``ends``, before the watermark of the batch.

    The watermark follows from the newest time of the batches before the last one, as in a windowed
    aggregation of the same batches, which drops exactly these rows.
    """
    spark = rows.sparkSession
    rows.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
    seen = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/seen").where(F.col("batch") < batch_id - LAG)
    newest = seen.agg(F.max("newest")).first()[0]
    mark = F.lit(newest).cast("timestamp") - F.expr(f"interval {late}")
    rows.where(ends <= mark).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")


#: A batch drops rows by the watermark that the batch before it ran with.
LAG = 1


def run_late(events: DataFrame, path: str, ends: Column, late: str, ts: str = "ts") -> DataFrame:
    """Process all data present; the late rows, with the batch they came in."""
    writer = events.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda rows, batch_id: late_batch(rows, batch_id, path, ends, late, ts)).start().awaitTermination()
    schema = StructType([*events.schema.fields]).add("batch", "long")
    return events.sparkSession.read.schema(schema).parquet(f"{path}/late")
