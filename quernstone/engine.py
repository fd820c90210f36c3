"""One session: catalog, planner, store, tiering, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from . import metrics
from .catalog import RID, Catalog, numbered_file
from .model import Kind, Query, QueryError, Status
from .plans.planner import Planner
from .sources import files, snapshot
from .sources.store import Store
from .sources.text import read_columns
from .tiering import COLD, HOST, Tiering


class Engine:
    def __init__(self, spark: SparkSession, store: str | None = None, group_cap: int | None = None, compat: bool = False, budget: int = 1 << 40):
        self.spark, self.catalog = spark, Catalog(spark)
        self.planner = Planner(self.catalog, group_cap, compat)
        self.store = Store(spark, store) if store else None
        self.tiering, self.latency = Tiering(budget), metrics.Latency()

    def load_parquet(self, path: str, dataset: str, kinds: dict[str, Kind | str] | None = None) -> DataFrame:
        """All columns of a Parquet table: integers as i64 unless kinds says u32, doubles, strings; times as
        microseconds. Nothing is read before a query needs it, and then only its columns."""
        frame = self.spark.read.parquet(path)
        found, out = {}, []
        for f in frame.schema.fields:
            kind, column = (kinds or {}).get(f.name), F.col(f"`{f.name}`")
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                column, kind = F.unix_micros(column.cast("timestamp")), kind or Kind.I64
            elif isinstance(f.dataType, T.IntegralType):
                column, kind = column.cast("long"), kind or Kind.I64
            elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
                column, kind = column.cast("double"), kind or Kind.F64
            elif isinstance(f.dataType, T.StringType):
                kind = kind or Kind.STR
            else:
                continue
            found[f.name] = Kind(kind)
            out.append(column.alias(f.name))
        self.catalog.register(dataset, frame.select(*out), found)
        self.catalog._numbered[dataset] = numbered_file(frame).select(RID, *out)
        return frame

    def load_rows(self, dataset: str, columns: dict[str, tuple[Kind | str, list]], nulls: dict[str, list[int]] | None = None) -> None:
        """Columns from lists of equal length; nulls: 1 marks a NULL."""
        kinds = {n: Kind(k) for n, (k, _) in columns.items()}
        values = [[None if (nulls or {}).get(n, [0] * len(v))[i] else v[i] for i in range(len(v))] for n, (_, v) in columns.items()]
        if len({len(v) for v in values}) > 1:
            raise QueryError(Status.INVALID_GROUP, "columns of different lengths")
        for (name, kind), column in zip(kinds.items(), values, strict=True):
            if kind is Kind.U32 and any(x is not None and not 0 <= x < 2**32 for x in column):
                raise QueryError(Status.UNSUPPORTED_TYPE, f"{name} has a value beyond u32")
        schema = T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(n, k.spark) for n, k in kinds.items())])
        rows = [(i, *r) for i, r in enumerate(zip(*values, strict=True))]
        self._own(dataset, self.spark.createDataFrame(rows, schema), kinds)

    def _own(self, dataset: str, frame: DataFrame, kinds: dict[str, Kind]) -> None:
        self.catalog.register(dataset, frame, kinds)
        for name in kinds:
            self.tiering.add(name, 8)

    def load_csv(self, path: str, columns: dict[str, tuple[int, Kind | str]], dataset: str | None = None, header: bool = False, delimiter: str = ",") -> None:
        kinds = {n: Kind(k) for n, (_, k) in columns.items()}
        frame = read_columns(self.spark, path, {n: (at, kinds[n]) for n, (at, _) in columns.items()}, header, delimiter)
        self._own(dataset or path, frame, kinds)

    def append(self, dataset: str, columns: dict[str, list]) -> None:
        """Rows after the last; every column of the dataset must be given."""
        mine = {c.field: c for c in self.catalog.columns.values() if c.dataset == dataset}
        if set(columns) != set(mine) or len({len(v) for v in columns.values()}) != 1:
            raise QueryError(Status.INVALID_GROUP, "append needs every column of the dataset, equally long")
        start, old = self.catalog.rows(dataset), self.catalog.numbered(dataset)
        schema = T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(n, mine[n].kind.spark) for n in columns)])
        fresh = self.spark.createDataFrame([(start + i, *r) for i, r in enumerate(zip(*columns.values(), strict=True))], schema)
        self.catalog.register(dataset, old.unionByName(fresh), {n: c.kind for n, c in mine.items()}, {n: c.name for n, c in mine.items()})

    def sql(self, text: str) -> DataFrame:
        return self.planner.sql(text)

    def query(self, query: Query) -> DataFrame:
        return self.planner.plan(query)

    def run(self, text: str) -> tuple[list[str], list[Row]]:
        with self.latency.timed():
            frame = self.sql(text)
            return frame.columns, frame.collect()

    def save(self, path: str) -> bool:
        return snapshot.save(self.catalog, path)

    def load(self, path: str) -> bool:
        return snapshot.load(self.catalog, path)

    def backup(self, prefix: str) -> bool:
        """Catalog and store state under one prefix."""
        if self.store:
            self.store.state().write.mode("overwrite").parquet(f"{prefix}.kv")
        return self.save(f"{prefix}.catalog")

    def restore(self, prefix: str) -> bool:
        """False, with all as it was, if there is no sound catalog or the store has no room for every key."""
        kept = None
        if self.store:
            kept = self.spark.read.parquet(f"{prefix}.kv") if files.exists(self.spark, f"{prefix}.kv") else None
            if kept is None or kept.select("key").union(self.store.state().select("key")).distinct().count() > self.store.capacity:
                return False
        if not self.load(f"{prefix}.catalog"):
            return False
        if kept is not None:
            self.store.write(kept, "key")
        return True

    def save_column(self, name: str, path: str) -> None:
        snapshot.save_column(self.catalog, name, path)

    def load_column(self, path: str, name: str | None = None) -> str:
        return snapshot.load_column(self.catalog, path, name)

    def health(self) -> dict[str, int]:
        pending = len(self.store.about["log"]) + len(self.store.pending) if self.store else 0
        dropped = self.store.dropped if self.store else 0
        return dict(zip(metrics.HEALTH, (int(dropped == 0), int(self.store is not None), len(self.catalog.columns), self.tiering.used(), pending, dropped), strict=True))

    def stats(self) -> dict[str, int]:
        t, lat = self.tiering, self.latency
        cold = sum(i.size for i in t.items.values() if i.tier == COLD)
        host = sum(i.size for i in t.items.values() if i.tier == HOST)
        values = (t.borrows, t.rebalances, t.migrations, len(self.catalog.columns), host, cold, lat.count, lat.total, lat.largest, lat.percentile(0.5), lat.percentile(0.99), metrics.packed_version())
        return dict(zip(metrics.STATS, values, strict=True))

    def close(self) -> None:
        if self.store:
            self.store.close()
