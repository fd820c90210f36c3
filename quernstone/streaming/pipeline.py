"""The operation stream: reads, writes and scans as a Structured Streaming query with idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.keyvalue import get, latest
from ..sources import files

READ, WRITE, SCAN, TXN_WRITE = 1, 2, 3, 4
OPERATIONS = "seq long, opcode int, key long, value long"
BATCH_ROWS, BATCH_MICROS = 512, 50


def batches(frame: DataFrame, seq: str = "seq", rows: int = BATCH_ROWS) -> DataFrame:
    """Adds batch_id by size: rows that arrive in order fill batches of a fixed number of operations."""
    return frame.withColumn("batch_id", F.expr(f"{seq} div {rows}"))


def batches_by_age(frame: DataFrame, at: str, lane: str, micros: int = BATCH_MICROS, rows: int = BATCH_ROWS, seq: str | None = None) -> DataFrame:
    """Adds batch_id by size or age within each lane: a batch ends when it holds `rows` operations or its first one is
    `micros` old, whichever comes first. Operations of one time are in the order of `seq`, if given. Rows without a
    time have no batch. A lane is read in order with the state of its open batch only."""
    order = [F.col(c).asc_nulls_last() for c in (lane, at, *([seq] if seq else []))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, since, held, number = False, None, 0, 0
        now = None
        for part in parts:
            ids = []
            for own, time in zip(part.column(lane).to_pylist(), part.column(at).to_pylist(), strict=True):
                if time is None:
                    ids.append(None)
                    continue
                if not began or own != now:
                    began, now, since, held, number = True, own, time, 0, 0
                elif held >= rows or time - since >= micros:
                    since, held, number = time, 0, number + 1
                held += 1
                ids.append(number)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.int64())], names=[*part.schema.names, "batch_id"])

    schema = StructType([*frame.schema.fields, StructField("batch_id", LongType())])
    return frame.repartition(lane).sortWithinPartitions(*order).mapInArrow(run, schema)


def opcode_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("opcode").agg(F.count(F.lit(1)).alias("n"))


class Pipeline:
    """Folds micro-batches into key-value state on disk: each batch writes state number batch_id + 1 from state
    batch_id, so a batch that runs again gives the same state, and counts are kept by batch. The last `keep` states
    stay, more than the one that a stream may run again."""

    def __init__(self, spark: SparkSession, path: str, scanned: DataFrame | None = None, threshold: int = 0, keep: int = 8):
        self.spark, self.path, self.scanned, self.threshold, self.keep = spark, path, scanned, threshold, max(2, keep)

    def state(self, batch: int) -> DataFrame:
        """State before a batch: nothing before the first; FileNotFoundError if a later one is not there."""
        place = f"{self.path}/state/{batch}"
        if batch <= 0:
            return self.spark.createDataFrame([], "key long, value long, seq long")
        if not files.exists(self.spark, place):
            raise FileNotFoundError(place)
        return self.spark.read.parquet(place)

    def apply(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        old = self.state(number)
        writes = batch.where(F.col("opcode").isin(WRITE, TXN_WRITE)).select("key", "value", "seq")
        both = old.unionByName(writes)
        both.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{self.path}/state/{number + 1}")
        reads = get(old.select("key", "value"), batch.where(F.col("opcode") == READ).select("seq", "key"))
        reads.write.mode("overwrite").parquet(f"{self.path}/reads/{number}")
        counts = opcode_counts(batch)
        if self.scanned is not None:
            hits = self.scanned.where(F.col("v") > self.threshold).count()
            counts = counts.withColumn("scanned", F.when(F.col("opcode") == SCAN, F.col("n") * hits).otherwise(0))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/{number}")
        batch.unpersist()
        for name in files.names(self.spark, f"{self.path}/state"):
            if int(name) <= number + 1 - self.keep:
                files.delete(self.spark, f"{self.path}/state/{name}")

    def start(self, source: str, files_per_batch: int = 1) -> StreamingQuery:
        """Reads Parquet files as they come; at most files_per_batch in a batch is the back-pressure."""
        stream = self.spark.readStream.schema(OPERATIONS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()

    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts/*").groupBy("opcode").agg(*[F.sum(c).alias(c) for c in ("n", "scanned") if c == "n" or self.scanned is not None])

    def final_state(self) -> DataFrame:
        return self.state(max(map(int, files.names(self.spark, f"{self.path}/state")), default=0)).select("key", "value")


def state_after(operations: DataFrame) -> DataFrame:
    """The same state in one batch, for comparison."""
    return latest(operations.where(F.col("opcode").isin(WRITE, TXN_WRITE)))
