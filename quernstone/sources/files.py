"""Folders and small files wherever Spark itself can write: local, HDFS, object stores."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if it is not there."""
    place, system = _at(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    place, system = _at(spark, path)
    system.delete(place, True)


def _numbers(spark: SparkSession, folder: str, stem: str) -> list[int]:
    return sorted(int(m[1]) for n in names(spark, folder) if (m := re.fullmatch(rf"{stem}-(\d{{12}})\.json", n)))


def newest(spark: SparkSession, folder: str, stem: str) -> str | None:
    """The text that publish() left last."""
    numbers = _numbers(spark, folder, stem)
    if not numbers:
        return None
    place, system = _at(spark, f"{folder}/{stem}-{numbers[-1]:012d}.json")
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, stem: str, text: str) -> None:
    """Put a text in the place of the last one: it is written aside and renamed to the next number, so that a reader
    finds the old one or the new one whole, also after a crash."""
    old = _numbers(spark, folder, stem)
    part, system = _at(spark, f"{folder}/_{stem}.{uuid.uuid4().hex}")
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = _at(spark, f"{folder}/{stem}-{(old[-1] + 1 if old else 0):012d}.json")[0]
    if not system.rename(part, target):
        raise OSError(f"{target} was published by another writer")
    for number in old:
        delete(spark, f"{folder}/{stem}-{number:012d}.json")
