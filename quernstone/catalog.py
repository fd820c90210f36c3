"""Named, typed columns that live in datasets; columns of different datasets align by row number."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .model import Kind, QueryError, Status

RID = "_rid"


@dataclass(frozen=True)
class Column:
    name: str
    dataset: str
    field: str
    kind: Kind


class Catalog:
    """Datasets are DataFrames; a name registered again stands for the newest column."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock = spark, threading.RLock()
        self.frames: dict[str, DataFrame] = {}
        self.columns: dict[str, Column] = {}
        self.tables: dict[str, tuple[str, ...]] = {}
        self._counts: dict[str, int] = {}
        self._numbered: dict[str, DataFrame] = {}

    def register(self, dataset: str, frame: DataFrame, kinds: dict[str, Kind], names: dict[str, str] | None = None) -> None:
        with self.lock:
            self.frames[dataset] = frame
            self._counts.pop(dataset, None)
            self._numbered.pop(dataset, None)
            for field, kind in kinds.items():
                name = (names or {}).get(field, field)
                self.columns[name] = Column(name, dataset, field, Kind(kind))

    def column(self, name: str) -> Column:
        found = self.columns.get(name)
        if found is None:
            raise QueryError(Status.UNKNOWN_COLUMN, name)
        return found

    def rows(self, dataset: str) -> int:
        if dataset not in self._counts:
            self._counts[dataset] = self.frames[dataset].count()
        return self._counts[dataset]

    def numbered(self, dataset: str) -> DataFrame:
        """The dataset with its row numbers from 0, in file order for Parquet."""
        if dataset not in self._numbered:
            self._numbered[dataset] = numbered(self.frames[dataset])
        return self._numbered[dataset]

    def frame_for(self, *columns: Column, numbers: bool = False) -> DataFrame:
        """One frame with the columns by name; datasets beside the first join by row number and must be as long."""
        datasets = list(dict.fromkeys(c.dataset for c in columns))
        if len(datasets) == 1 and not numbers:
            return self.frames[datasets[0]].select(*{c.name: F.col(c.field).alias(c.name) for c in columns}.values())
        if len({self.rows(d) for d in datasets}) > 1:
            raise QueryError(Status.INVALID_GROUP, "columns of different lengths")
        parts = [self.numbered(d).select(RID, *{c.name: F.col(c.field).alias(c.name) for c in columns if c.dataset == d}.values()) for d in datasets]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.join(part, RID)
        return whole if numbers else whole.drop(RID)

    def table(self, name: str, columns: list[str]) -> DataFrame:
        """A named list of aligned columns, also as a temporary view."""
        if not columns:
            raise QueryError(Status.INVALID_GROUP, "a table needs columns")
        frame = self.frame_for(*[self.column(c) for c in columns])
        with self.lock:
            self.tables[name] = tuple(columns)
        frame.createOrReplaceTempView(name)
        return frame


def numbered_file(frame: DataFrame) -> DataFrame:
    """Adds row numbers from 0 to a plain Parquet scan: each row's place in its file after the rows of the files before
    it, which costs one count for each file."""
    placed = frame.select("*", F.col("_metadata.row_index").alias("_at"), F.col("_metadata.file_path").alias("_file"))
    if len(frame.inputFiles()) <= 1:
        return placed.withColumn(RID, F.col("_at")).drop("_at", "_file")
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("_file", before.alias("_before"))), "_file").withColumn(RID, F.col("_at") + F.col("_before")).drop("_at", "_before", "_file")


def numbered(frame: DataFrame) -> DataFrame:
    """Adds row numbers from 0 in the frame's order, from partition sizes and the place within each partition: the low
    33 bits of Spark's ids. A frame that has numbers stays as it is."""
    if RID in frame.columns:
        return frame
    marked = frame.withColumn("_id", F.monotonically_increasing_id()).persist()
    sizes = marked.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    numbered_rows = marked.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(offsets), "_part")
    return numbered_rows.withColumn(RID, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")
