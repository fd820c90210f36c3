"""A durable key-value store over an append-only Parquet log with checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.keyvalue import key_range, replay_by_transaction
from . import files

EACH, OFF = "each", "off"
LOG = "seq long, op string, txn long, key long, value long"


class Store:
    """Every put or committed transaction is one atomic append; reading folds checkpoint and log.

    An append is a folder that a manifest names once it is whole, so a crash leaves nothing that a reader takes for a
    record. capacity counts distinct keys: a put of a new key beyond it is dropped and counted. durability "each"
    writes every append at once; "off" holds appends in the driver, where reads see them, until flush(), checkpoint()
    or close(), and a crash loses them.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = 65536, durability: str = EACH):
        if durability not in (EACH, OFF):
            raise ValueError(f"durability is {EACH} or {OFF}, not {durability}")
        self.spark, self.path, self.capacity, self.durability = spark, path, capacity, durability
        self.open: list[tuple[int, int]] | None = None
        self.dropped, self.pending = 0, []
        found = files.newest(spark, path, "manifest")
        self.about = json.loads(found) if found else {"next": 0, "txn": 0, "checkpoint": None, "log": []}

    def _publish(self) -> None:
        files.publish(self.spark, self.path, "manifest", json.dumps(self.about))

    def _append(self, rows: list[tuple]) -> None:
        self.about["next"] += len(rows)
        self.pending += rows
        if self.durability == EACH:
            self.flush()

    def flush(self) -> None:
        """Appends that the driver holds become one durable folder."""
        if self.pending:
            name = f"log-{self.pending[0][0]:012d}"
            self.spark.createDataFrame(self.pending, LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")
            self.pending = []
            self.about["log"].append(name)
            self._publish()

    def write(self, rows: DataFrame, seq: str = "seq") -> int:
        """Put rows (key, value, in the order of seq) as one append, without passing them through the driver; returns
        how many keys had no room: the last to come of the new ones. Null keys are not stored."""
        self.flush()
        last = rows.where("key IS NOT NULL").groupBy("key").agg(F.max_by("value", seq).alias("value"), F.min(seq).alias("_first"))
        known = self.state().select("key")
        fresh, room = last.join(known, "key", "left_anti"), max(0, self.capacity - known.count())
        over = max(0, fresh.count() - room)
        if over:
            admitted = fresh.orderBy("_first", "key").limit(room).select("key")
            last = last.join(known.union(admitted), "key", "left_semi")
        name, at = f"log-{self.about['next']:012d}", self.about["next"]
        last.select(F.lit(at).cast("long").alias("seq"), F.lit("WRITE").alias("op"), F.lit(None).cast("long").alias("txn"), "key", "value").write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.dropped += over
        self.about["next"] += 1  # a key is there once, so one place serves all rows
        self.about["log"].append(name)
        self._publish()
        return over

    def log(self) -> DataFrame:
        parts = [f"{self.path}/{n}" for n in self.about["log"]]
        held = self.spark.createDataFrame(self.pending, LOG)
        if not parts:
            return held
        durable = self.spark.read.schema(LOG).parquet(*parts)
        return durable.unionByName(held) if self.pending else durable

    def state(self) -> DataFrame:
        """key, value as committed."""
        log = self.log()
        if self.about["checkpoint"]:
            old = self.spark.read.parquet(f"{self.path}/{self.about['checkpoint']}")
            log = log.unionByName(old.select(F.lit(-1).cast("long").alias("seq"), F.lit("WRITE").alias("op"), F.lit(None).cast("long").alias("txn"), "key", "value"))
        return replay_by_transaction(log)

    def _admit(self, rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
        asked = self.spark.createDataFrame([(k,) for k, _ in rows], "key long").distinct().withColumn("asked", F.lit(True))
        # one pass over the state for both: its size, and which of the asked keys it has
        both = self.state().join(F.broadcast(asked), "key", "left").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("asked"), F.col("key"))).alias("known")).first()
        known, room, out = set(both.known), self.capacity - both.n, []
        for key, value in rows:
            if key in known or room > 0:
                room -= key not in known
                known.add(key)
                out.append((key, value))
            else:
                self.dropped += 1
        return out

    def put(self, key: int, value: int) -> bool:
        rows = self._admit([(key, value)])
        if rows:
            self._append([(self.about["next"], "WRITE", None, key, value)])
        return bool(rows)

    def get(self, key: int) -> int | None:
        found = self.state().where(F.col("key") == key).first()
        return None if found is None else found.value

    def range(self, low: int, high: int, ordered: bool = True) -> DataFrame:
        return key_range(self.state(), low, high, ordered)

    def begin(self) -> None:
        if self.open is not None:
            raise RuntimeError("a transaction is open")
        self.open = []

    def txn_put(self, key: int, value: int) -> None:
        if self.open is None:
            raise RuntimeError("no transaction is open")
        self.open.append((key, value))

    def commit(self) -> None:
        if self.open is None:
            raise RuntimeError("no transaction is open")
        rows, self.open = self._admit(self.open) if self.open else [], None
        if rows:
            first, txn = self.about["next"], self.about["txn"]
            self.about["txn"] += 1
            self._append([*((first + i, "TXN", txn, k, v) for i, (k, v) in enumerate(rows)), (first + len(rows), "COMMIT", txn, None, None)])

    def rollback(self) -> None:
        self.open = None

    def checkpoint(self) -> None:
        """State as one Parquet folder in place of the log so far."""
        self.flush()
        if self.about["checkpoint"] and not self.about["log"]:
            return  # nothing came since
        name = f"checkpoint-{self.about['next']:012d}"
        self.state().write.mode("overwrite").parquet(f"{self.path}/{name}")
        old = [*self.about["log"], *([self.about["checkpoint"]] if self.about["checkpoint"] not in (None, name) else [])]
        self.about |= {"checkpoint": name, "log": []}
        self._publish()
        for part in old:
            files.delete(self.spark, f"{self.path}/{part}")

    def close(self) -> None:
        self.rollback()
        self.checkpoint()
