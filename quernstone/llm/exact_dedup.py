"""Exact deduplication with skew-safe combining.

Copies are first merged inside each map task, then inside (digest, salt) groups, then across salts. At each of the
three stages the whole normalised text is part of the grouping key, so two texts are merged only if they are equal in
full; the digest only decides where rows meet. A text that a third of all rows share reaches the salted stage as a few
rows for each map task and the last stage as one row for each salt, so no task ever gathers the copies themselves; when
the decision goes back to the rows, they meet it by salt again. Texts of one digest that differ would be told apart by
their content there too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import ascii_lower, attached, salt, salts_seen, written


def normalised(text):
    return ascii_lower(F.coalesce(text, F.lit("")))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{key}`").alias("id"), normalised(F.col(f"`{text}`")).alias("content"))
    return rows.select("id", "content", F.sha2("content", 256).alias("digest"), salt("id").alias("salt"))


def combine(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct normalised text: digest, keep_id (the largest key), group_size, salts (the parts its
    rows are in), and content, null unless other texts share the digest."""
    salted = _rows(docs, key, text).groupBy("digest", "content", "salt").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    # by digest alone, so that texts of one digest meet
    found = salted.repartition("digest").groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), salts_seen(F.col("salt")).alias("salts"))
    several = F.count(F.lit(1)).over(Window.partitionBy("digest")) > 1
    return found.select("digest", "keep_id", "group_size", "salts", F.when(several, F.col("content")).alias("content"))


def _decided(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, digest, keep_id, group_size for each row."""
    classes = written(combine(docs, key, text), "classes")
    rows = _rows(docs, key, text)
    found = attached(rows.select("id", "digest", "salt"), classes.where(F.col("content").isNull()).drop("content"), "digest")
    shared = classes.where(F.col("content").isNotNull()).drop("salts")
    if shared.isEmpty():
        return found
    return found.unionByName(rows.drop("salt").join(shared, ["digest", "content"]).drop("content"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Say for each row which row of its equal texts stays.

    Texts are equal if they are identical after lower-casing A-Z only; the largest key stays. Returns key, keep_id,
    group_size, kept, text_sha256, one row for each input row.

    Defined cases: a null text counts as empty, and all empty texts form one group; texts may be very long. A null key
    ranks below all others; a group of null keys only has a null keep_id and keeps its rows. Rows that repeat one key in
    one group share its decision. Other columns are not read. An empty table gives an empty result.
    """
    return _decided(docs, key, text).select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, all columns of docs: that of the largest key, and of rows that repeat that
    key and text one. Nulls, empty texts and an empty table are as in exact_dedup(); a group of null keys keeps one row."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    own, th = F.col(names[key]), F.sha2(normalised(F.col(names[text])), 256)
    chosen = _decided(docs, key, text).where(F.col("id").eqNullSafe(F.col("keep_id"))).select("keep_id", "digest").distinct()
    kept = rows.join(chosen, own.eqNullSafe(F.col("keep_id")) & (th == F.col("digest")), "left_semi")
    return kept.withColumn("_content", normalised(F.col(names[text]))).dropDuplicates([names[key], "_content"]).drop("_content").toDF(*docs.columns)


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
