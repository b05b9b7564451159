"""Near-duplicate embeddings by random-hyperplane sign hashing (operator 8).

Equal vectors of a label, told by 128 bits, are one class. Each class has a code of BITS signs in each of several tables; classes of one label
that agree in a table's code are compared there by exact cosine in double precision, in blocks of bounded size. A pair
counts only in the first table in which it agrees, so link counts are exact for all pairs that some table holds, and
blocks give counts and spanning links, never pairs. Bits grow with the logarithm of the classes; the number of tables
follows so that a pair at the border is missed with probability MISS at most.

Defined results: vectors with null label, and vectors that are null, zero or hold null or non-finite components, link
with nothing; vectors of different length are never compared; rows that repeat a vector link with one another, also
if they repeat the id. A null id stands in no minimum; its component is null where no other id is reached. Components of
any finite size are compared: vectors are scaled by a power of two first, which is exact. Other columns are not looked
at and may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Workspace, beside, components, join_classes
from tickloom.llm.worker import lean

MISS, SEED = 1e-4, 29
#: Classes in a block; bounds a task's memory, not the result.
BLOCK = 1024


def plan_tables(classes: int, cosine: float) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = min(48, max(12, math.ceil(math.log2(max(2, classes))) + 2))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _coder(bits: int, tables: int):
    planes: dict[int, np.ndarray] = {}

    def codes(vectors: list[list[float]]) -> np.ndarray:
        x = scaled(np.array(vectors, np.float64))
        if x.shape[1] not in planes:
            planes[x.shape[1]] = np.random.default_rng(SEED).normal(size=(x.shape[1], bits * tables))
        signs = (x @ planes[x.shape[1]] > 0).reshape(len(x), tables, bits)
        return (signs.astype(np.int64) << np.arange(bits)).sum(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding").to_pylist()
            out: list = [None] * len(vectors)
            for length in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == length]
                for i, c in zip(rows, codes([vectors[i] for i in rows]), strict=True):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("cid", "label", "embedding", "copies")] + [pa.array(out, pa.list_(pa.int64()))], names=["cid", "label", "embedding", "copies", "codes"])

    return run


def block_links(x: np.ndarray, codes: np.ndarray, table: int, copies: np.ndarray, side: np.ndarray | None, cosine: float):
    """(links of each row to other classes, spanning links): pairs of rows, on different sides where sides are given, that agree in this table first and reach the cosine."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None]
    for t in range(table):
        near &= codes[:, None, t] != codes[None, :, t]
    links, left, edges = near @ copies, np.ones(len(x), bool), []
    for first in range(len(x)):
        if not left[first]:
            continue
        left[first], reached = False, [first]
        while reached:
            i = reached.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            edges += [(i, int(j)) for j in new]
            reached += new.tolist()
    return links, edges


def _block(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        cid, links, other = [], [], []
        keys = table["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            part = table.take(pa.array(rows))
            ids, task = part["cid"].to_numpy(), part["task"][0].as_py()
            side = part["own"].to_numpy() if task["i"] != task["j"] else None
            x = scaled(np.array(part["embedding"].to_pylist(), np.float64))
            x /= np.sqrt((x * x).sum(1))[:, None]
            got, edges = block_links(x, np.array(part["codes"].to_pylist()), int(part["t"][0].as_py()), part["copies"].to_numpy(), side, cosine)
            cid += [*ids.tolist(), *(int(ids[i]) for i, _ in edges)]
            links += [*got.tolist(), *[0] * len(edges)]
            other += [*[None] * len(ids), *(int(ids[j]) for _, j in edges)]
        return pa.table({"cid": pa.array(cid, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.int64())})

    return run


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, cosine: float = 0.98, work: Workspace | None = None) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    work = work or Workspace(vectors.sparkSession, "embeddings")
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    good = F.coalesce(F.col(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(good, v).alias("embedding"))
    there = F.col("embedding").isNotNull()
    rows = work.write(rows.withColumns({"h1": F.when(there, F.xxhash64("label", "embedding")), "h2": F.when(there, F.xxhash64(F.lit(SEED), "label", "embedding"))}), "rows")
    classes = rows.where("h1 is not null").groupBy("h1", "h2", "label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = work.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits, tables = plan_tables(classes.count(), cosine)
    coded = work.write(classes.select("cid", "label", "embedding", "copies").mapInArrow(lean(_coder(bits, tables)), f"cid long, label {dict(rows.dtypes)['label']}, embedding array<double>, copies long, codes array<long>"), "coded")

    keyed = coded.select("cid", "label", F.size("embedding").alias("size"), F.posexplode("codes").alias("t", "code"))
    keyed = keyed.select("cid", "t", F.xxhash64("label", "size", "t", "code").alias("key"))
    shared = work.write(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    placed = keyed.join(beside(shared), "key").select("cid", "t", "key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    packs = int(shared.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]) // (4 * BLOCK) + 1
    placed = placed.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).otherwise(0))
    tasks = F.expr(f"""if(blocks = 1, array(struct(pmod(key, {packs}) as p, -1 as i, -1 as j)),
        transform(sequence(0, blocks - 1), x -> struct(key as p, least(x, own) as i, greatest(x, own) as j)))""")
    placed = placed.select("cid", "t", "key", "own", F.explode(tasks).alias("task"))
    found = placed.join(coded.select("cid", "embedding", "copies", "codes"), "cid").groupBy("task").applyInArrow(_block(cosine), "cid long, links long, other long")
    found = work.write(found, "found")
    comp = work.write(components(work, found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")), "linked"), "roots")
    links = found.where("other is null").groupBy("cid").agg(F.sum("links").alias("far"))
    known = classes.select("h1", "h2", "cid", "copies", "least").join(links, "cid", "left").join(comp, F.col("cid") == F.col("v"), "left")
    known = work.write(known.select("h1", "h2", "copies", "least", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n"), F.coalesce("comp", "cid").alias("root"), F.col("comp").isNotNull().alias("linked")), "known")
    first = known.where("linked").groupBy("root").agg(F.min("least").alias("first"))
    known = known.where("n > 0").join(first, "root", "left").select("h1", "h2", "copies", "n", F.when(F.col("linked"), F.col("first")).otherwise(F.col("least")).alias("least"))
    known = work.write(known, "linked_classes")
    ids = rows.select("vec_id", "h1", "h2")
    found = join_classes(ids.where("h1 is not null"), known, ["h1", "h2"], "copies", "left").select("vec_id", "n", "least")
    out = found.union(ids.where("h1 is null").select("vec_id", F.lit(None).cast("long"), F.lit(None)))
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
