"""What the operators share: batches of bounded size, checked broadcasts, joins with hot classes and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.workspace import Workspace, beside, bounded_batches, keyed, small

__all__ = ["Workspace", "beside", "bounded_batches", "components", "hashed", "join_classes", "keyed", "small"]

#: Members from which a class is joined by broadcast, as all its rows would meet in one task; so classes of that size are few.
HOT = 4096


def hashed(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the data: built into hash tables by shuffle at every size, so the other side isn't sorted."""
    return df.hint("shuffle_hash")


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined to their classes (written, keys not null, `size` members each): hot classes by broadcast, the others by shuffle.

    There are at most as many hot classes as rows / HOT; where even they are too many bytes, only larger ones count as hot.
    """
    least = HOT
    while not small(hot := classes.where(F.col(size) >= least)):
        least *= 8
    if not hot.limit(1).count():
        return rows.join(hashed(classes), keys, how)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(hashed(classes.where(F.col(size) < least)), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(v, comp) for the vertices of edges (a, b: longs, not null): comp is the smallest vertex that can be reached.

    Alternates large-star and small-star; each round is two grouped minima, which combine before the shuffle, and
    joins back on the vertex, whose hot keys adaptive execution splits. Rounds are written, so lineage stays short.
    """
    e = work.write(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{name}-0")
    k, was = 0, None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").selectExpr("b x", "a", "m")
        small_star = small_star.selectExpr("explode(array(struct(x as a, m as b), struct(a as a, m as b))) e").select("e.*").where("a <> b").distinct()
        k += 1
        e = work.write(small_star, f"{name}-{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        work.drop(f"{name}-{k - 1}")
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("comp")).union(e.selectExpr("b v", "b comp").distinct())
