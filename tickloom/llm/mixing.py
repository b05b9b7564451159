"""Mixing sources to target weights by entropy balancing (operator 10), in DataFrame and SQL functions only.

Document rates w minimise the sum of size * (w ln w - w) under one token constraint a source. The convex dual has one
variable a source, the rates are the exponentials of it (the tilt), at most CAP; Newton iterations sum gradient and
curvature over all documents, held as counts by source and size. Rates become whole copies by systematic rounding in
order of size, which leaves at most about one document's words a source; two passes then move single copies of
documents whose size is nearest to what is left.

Defined results: a null text has no words; null sources are one source, the last; sources without words have target 0;
null ids come first in the order of documents; rows that repeat an id are documents of their own, ordered by a hash of
their texts, and each is taken CAP times at most. An empty table gives no rows. Other columns are not looked at and may
have any names. Ordering needs no randomness, so reruns agree; only rows equal in id, source and text may change places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import Workspace, beside, keyed

#: Most copies of a document.
CAP = 3
#: Documents of one source and one size that are ordered in one task; larger cells are split by a hash of id and text.
CELL = 50_000
#: Newton's stopping rule: relative error of every token constraint.
TOLERANCE = 1e-12
PASSES = 2


def words(text):
    """Number of runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (source, source_size) its target: weights 1, 2, 3 in turn, at most CAP times its size, the rest shared again.

    Filling by level: sources in order of CAP * size / weight reach their limit as long as the common level lies above.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", 1 + (F.row_number().over(order) - 1) % 3).withColumn("limit", CAP * F.col("source_size"))
    fill = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, behind = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("all_words", F.sum("source_size").over(W.partitionBy()))
    s = s.withColumn("rest", F.col("all_words") - F.coalesce(F.sum("limit").over(before), F.lit(0))).withColumn("shares", F.sum("weight").over(behind))
    s = s.withColumn("full", F.col("limit") * F.col("shares") <= F.col("rest") * F.col("weight"))
    open_rest = F.max(F.when(~F.col("full"), F.struct("shares", "rest"))).over(W.partitionBy())
    s = s.withColumn("open", open_rest)
    level = F.col("open.rest").cast("double") * F.col("weight") / F.col("open.shares")
    return s.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level).alias("target"))


def _newton(work: Workspace, cells: DataFrame, goal: DataFrame, most: int = 200) -> DataFrame:
    """(source, rate): rate = min(CAP, exp(lambda)), lambda by Newton's method on the dual; a source without target has rate 0."""
    state = work.write(goal.select("source", "target", F.lit(0.0).alias("lam")), "dual-0")
    rate = F.when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(CAP)), F.exp("lam")))
    for k in range(1, most):
        tilted = cells.join(beside(state.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
        mass = F.sum(F.col("n") * F.col("size") * F.exp("lam"))  # gradient: target - mass; curvature: mass
        state = tilted.groupBy("source", "target", "lam").agg(mass.alias("mass"))
        error = F.when(F.col("target") > 0, F.abs(F.col("target") - F.col("mass")) / F.col("target")).otherwise(0.0)
        step = F.when(F.col("target") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - F.col("mass")) / F.col("mass")))).otherwise(0.0)
        state = work.write(state.select("source", "target", (F.col("lam") + step).alias("lam"), error.alias("error")), f"dual-{k}")
        work.drop(f"dual-{k - 1}")
        worst = state.agg(F.max("error")).first()[0]
        state = state.drop("error")
        if worst is None or worst <= TOLERANCE:
            return state.select("source", F.round(rate, 9).alias("rate"))
    raise ArithmeticError(f"the dual did not converge: {worst}")


def _planned(work: Workspace, docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(kf, kr, doc_id, source, size, source_size, target, copies) for each row of keyed docs."""
    text = F.col("row")[text_col]
    rows = work.write(docs.select("kf", "kr", F.col("row")[id_col].alias("doc_id"), F.col("row")[source_col].alias("source"), words(text).alias("size"), F.xxhash64(text).alias("th")), "rows")
    counts = work.write(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    goal = work.write(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))), "goal")
    rates = _newton(work, counts, goal)
    plan = work.write(goal.join(rates, goal.source.eqNullSafe(rates.source)).select(goal.source.alias("s"), "source_size", "target", "rate"), "plan")

    # Places in the order (size, part, id) of each source: cells first, then rows within a cell of bounded size.
    large = work.write(counts.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.ceil(F.col("n") / CELL).alias("parts")).where("parts > 1"), "large")
    here = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    placed = rows.join(beside(large), here, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "th"), F.col("parts")), F.lit(0))).drop("c_source", "c_size", "parts")
    whole = counts.join(beside(large), here, "left_anti").select("source", "size", F.lit(0).cast("long").alias("part"), "n")
    split = placed.join(beside(large), here, "left_semi").groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    cells = whole.unionByName(split)
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("size", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    known = starts.join(beside(plan), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("k_source"), F.col("size").alias("k_size"), F.col("part").alias("k_part"), "start", "source_size", "target", "rate")
    known = beside(work.write(known, "known"))
    at = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("doc_id", "th", "kr", "kf"))
    joined = placed.withColumn("at", at).join(known, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size")) & (F.col("part") == F.col("k_part")))
    end = F.col("start") + F.col("at")
    copies = F.floor(end * F.col("rate") + 0.5) - F.floor((end - 1) * F.col("rate") + 0.5)
    cols = ["kf", "kr", "doc_id", "source", "size", "source_size", "target"]
    out = work.write(joined.select(*cols, end.alias("place"), copies.cast("long").alias("copies")), "copies-0")

    for k in range(PASSES):
        got = out.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("got")).select(F.col("source").alias("s"), (F.col("target") - F.col("got")).alias("left"))
        at_hand = out.join(beside(work.write(got, f"left-{k}")), F.col("source").eqNullSafe(F.col("s")))
        may = (F.col("size") > 0) & F.when(F.col("left") > 0, F.col("copies") < CAP).otherwise(F.col("copies") > 0) & (F.abs(F.abs("left") - F.col("size")) < F.abs("left"))
        nearest = at_hand.where(may).groupBy("source").agg(F.min(F.struct(F.abs(F.abs("left") - F.col("size")).alias("off"), "size", "place")).alias("x"), F.min(F.signum("left")).cast("long").alias("move"))
        nearest = work.write(nearest.select(F.col("source").alias("s"), F.col("x.place").alias("p"), "move"), f"move-{k}")
        moved = out.join(beside(nearest), F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")), "left")
        out = work.write(moved.select(*cols, "place", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies")), f"copies-{k + 1}")
        work.drop(f"copies-{k}")
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, work: Workspace | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, source."""
    work = work or Workspace(docs.sparkSession, "mixing")
    out = _planned(work, keyed(work, docs), id_col, text_col, source_col)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    work = Workspace(docs.sparkSession, "mix")
    rows = keyed(work, docs)
    plan = work.write(_planned(work, rows, id_col, text_col, source_col).where("copies > 0").select("kf", "kr", "copies"), "taken")
    both = rows.join(beside(plan), ["kf", "kr"])
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
