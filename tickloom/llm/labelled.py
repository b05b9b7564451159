"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that no classifier may learn from; a null id is never learned from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(True))


def eligible(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the documents that may be learned from; those with rows of both labels are left out."""
    known = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("most"))
    return known.where("y = most").select("doc_id", "y")


def label_weights(labels: DataFrame, label: str, most: int) -> tuple[float, float]:
    """What a row of `sample` stands for, by label: how many rows of its label there are to one that is taken."""
    n = {r.y: r["n"] for r in eligible(labels, label).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return tuple(max(1.0, n.get(y, 0) / (most // 2)) for y in (0, 1))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[str, int]]:
    """(text, label) of at most `most` labelled rows that are not held out, half of each label where there are enough.

    The rows are those with the smallest hashes of their ids, so reruns learn from the same ones; of rows that repeat an
    id, the one with the smallest hash of its text.
    """
    marked = eligible(labels, label).withColumn("h", F.xxhash64(F.lit(17), "doc_id"))
    chosen = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy("h", "doc_id").limit(most // 2).collect()]
    if not chosen:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, r.y, r.h) for r in chosen], "doc_id long, y int, h long")
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = known.groupBy("doc_id", "y", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(((r.h, r.doc_id, r.text or "", r.y) for r in found.toLocalIterator()), key=lambda r: r[:3])
    return [r[2:] for r in rows]
