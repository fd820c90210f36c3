"""A catalog as Parquet and one manifest; a snapshot is there whole or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException

from ..catalog import RID, Catalog
from ..model import Kind
from . import files


def save(catalog: Catalog, path: str) -> bool:
    """Write every dataset to a new folder inside path, then publish the manifest that names it. The version before
    stays for readers that still hold it; older ones go. A crash leaves the last published version."""
    spark, version = catalog.spark, f"v-{uuid.uuid4().hex}"
    about = {"version": version, "columns": [[c.name, c.dataset, c.field, c.kind.value] for c in catalog.columns.values()], "tables": catalog.tables}
    try:
        before = files.newest(spark, path, "catalog")
        for dataset, frame in catalog.frames.items():
            frame.write.parquet(f"{path}/{version}/{dataset}")
        files.publish(spark, path, "catalog", json.dumps(about))
        kept = {version, json.loads(before)["version"] if before else None}
        for name in files.names(spark, path):
            if name.startswith("v-") and name not in kept:
                files.delete(spark, f"{path}/{name}")
        return True
    except (OSError, Py4JJavaError):
        files.delete(spark, f"{path}/{version}")
        return False


def load(catalog: Catalog, path: str) -> bool:
    """Register what save() wrote; False, with the catalog as it was, if there is no sound manifest."""
    try:
        about = json.loads(files.newest(catalog.spark, path, "catalog") or "")
        frames = {d: catalog.spark.read.parquet(f"{path}/{about['version']}/{d}") for d in {c[1] for c in about["columns"]}}
        kinds = [(name, dataset, field, Kind(kind)) for name, dataset, field, kind in about["columns"]]
    except (OSError, ValueError, KeyError, Py4JJavaError, AnalysisException):
        return False
    for name, dataset, field, kind in kinds:
        catalog.register(dataset, frames[dataset], {field: kind}, {field: name})
    catalog.tables.update({k: tuple(v) for k, v in about["tables"].items()})
    return True


def save_column(catalog: Catalog, name: str, path: str) -> None:
    """One column with its row numbers, and its kind beside it."""
    column = catalog.column(name)
    catalog.frame_for(column, numbers=True).select(RID, f"`{name}`").write.mode("overwrite").parquet(f"{path}/rows")
    files.publish(catalog.spark, path, "column", json.dumps({"name": name, "kind": column.kind.value}))


def load_column(catalog: Catalog, path: str, name: str | None = None) -> str:
    """Register what save_column() wrote as a dataset of its own, under its name or another; returns that name."""
    found = files.newest(catalog.spark, path, "column")
    if found is None:
        raise FileNotFoundError(path)
    about = json.loads(found)
    shown = name or about["name"]
    rows = catalog.spark.read.parquet(f"{path}/rows").withColumnRenamed(about["name"], shown)
    catalog.register(path, rows, {shown: Kind(about["kind"])})
    return shown
