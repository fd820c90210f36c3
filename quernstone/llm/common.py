"""Helpers shared by the text operators: reading tables, the shared folder, and byte-bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES, ARROW_ROWS = 1 << 20, 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, UPPER, LOWER)


#: Parts that rows of one key may be dealt into where they meet what belongs to the key.
SALTS = 16


def salt(*by: str):
    """A row's part, by what tells it apart from others of its key."""
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts_seen(part):
    """For an aggregation by key: which parts its rows are in, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), part))


def attached(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Inner join on key of rows, with their part in `salt`, and one row for each key with its bits in `salts`: a key
    that a third of all rows share meets its class in SALTS tasks."""
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    return rows.join(classes.withColumn("salt", F.explode(parts)).drop("salts"), [key, "salt"]).drop("salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def _freeing(spark: SparkSession):
    """Inside, shuffle files go at the end of the SQL execution that made them, and of the plan's description, which
    the driver keeps for every execution, no more than a few pages stay."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "10000"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the shuffle files behind it go."""
    shared_folder(df.sparkSession)
    with _freeing(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, scratch: list | None = None) -> DataFrame:
    """Write to the shared folder as Parquet and read it back: a compact way to cut lineage for wide rows. The shuffle
    files behind it go. scratch: gets the path, for dropped()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with _freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, scratch: list) -> None:
    """Delete tables of written() that nothing reads any more."""
    for path in scratch:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    scratch.clear()


def map_arrow(frame: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of ARROW_ROWS rows, so that a worker holds a few MB of texts at a time. Workers live on
    from stage to stage: at a task's end they give back what they kept."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def whole_task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return frame.mapInArrow(whole_task, schema)


#: What a worker keeps between batches; each is called at a task's end.
RELEASES: list = []


def release() -> None:
    for give_back in RELEASES:
        give_back()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the column `text` of each has about `limit` bytes; one long text stays whole."""
    for batch in batches:
        column = batch.column(text)
        if column.type != pa.large_string() and column.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        lengths = [x or 0 for x in pc.binary_length(column).to_pylist()]
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(lengths) > start:
            yield batch.slice(start)
