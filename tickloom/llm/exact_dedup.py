"""Exact deduplication by an exchange of Golomb-coded fingerprints (operator 2).

1. Each partition takes a 48-bit fingerprint of every normalised text, sorts the distinct ones, and sends to the owner
   of each fingerprint range one Golomb-coded list, with a bit for those that it holds more than once itself.
2. An owner decodes the lists of its range and answers each partition with a bitmap of the places that others hold too.
   The bitmaps, a bit a text, come back to the rows by broadcast as long as they are small.
3. Only texts under marked fingerprints (the suspects) are read again and shuffled; grouping by fingerprint and whole
   normalised text compares their bytes. Copies combine before that shuffle, so a hot text is one row a task. All other
   rows are done without being moved.

Defined results: a null text counts as empty, and all empty texts form one group; a null id sorts after all others;
of rows that tie in length and id, the first of its file stays, and one row stays whatever else they hold. An empty table
gives no rows. Other columns are not looked at and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Workspace, beside, join_classes, keyed
from tickloom.llm.worker import lean

#: Fingerprint bits. A chance agreement only makes one more suspect, which the byte comparison clears.
FP_BITS = 48
#: Rows that a partition codes at a time; bounds a task's memory, not the result.
CHUNK = 200_000
SPACE = " \t\n\u000b\f\r"


def golomb_encode(sorted_values: np.ndarray) -> tuple[int, bytes]:
    """Ascending int64 values to (Rice parameter, bytes): unary quotients of the gaps, then their low bits."""
    n = len(sorted_values)
    gaps = np.diff(sorted_values, prepend=0)
    k = max(0, int(np.log2(max(1.0, 0.69 * float(sorted_values[-1]) / n)))) if n else 0
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel()
    return k, np.packbits(np.concatenate([unary, low])).tobytes()


def golomb_decode(k: int, n: int, blob: bytes) -> np.ndarray:
    """Inverse of golomb_encode for n values."""
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits)[:n] if n else np.zeros(0, np.int64)
    start = int(ends[-1]) + 1 if n else 0
    low = bits[start : start + n * k].reshape(n, k).astype(np.int64)
    gaps = ((np.diff(ends, prepend=-1) - 1) << k) + (low << np.arange(k)).sum(1)
    return np.cumsum(gaps)


def _sender(owners: int, schema: pa.Schema):
    """Rows with their place in their partition's list (kind 0), and the lists to send (kind 1)."""

    def lists(src: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        fp = table["fp"].to_numpy()
        values, place, count = np.unique(fp, return_inverse=True, return_counts=True)
        owner = (values >> (FP_BITS - 24)) * owners >> 24
        first = np.searchsorted(owner, np.arange(owners + 1))
        rows = len(fp)
        cols = {n: table[n].combine_chunks() for n in table.column_names}
        cols |= {"kind": np.zeros(rows, np.int32), "src": np.full(rows, src), "owner": owner[place], "pos": place - first[owner[place]]}
        full = [o for o in range(owners) if first[o] < first[o + 1]]
        sent: dict[str, list] = {"kind": [1] * len(full), "src": [src] * len(full), "owner": full, "pos": [], "k": [], "blob": [], "several": []}
        for o in full:
            part = slice(first[o], first[o + 1])
            k, blob = golomb_encode(values[part])
            sent["pos"].append(int(first[o + 1] - first[o]))
            sent["k"].append(k)
            sent["blob"].append(blob)
            sent["several"].append(np.packbits(count[part] > 1).tobytes())
        for got, size in ((cols, rows), (sent, len(full))):
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name]).cast(f.type) if f.name in got else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size, k = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                yield from lists((part << 20) + k, pa.Table.from_batches(held))
                held, size, k = [], 0, k + 1
        if size:
            yield from lists((part << 20) + k, pa.Table.from_batches(held))

    return run


def _owner(table: pa.Table) -> pa.Table:
    """For each list of this range, the places whose fingerprints stand more than once."""
    n = table["pos"].to_numpy()
    lists = [golomb_decode(k, m, b) for k, m, b in zip(table["k"].to_pylist(), n.tolist(), table["blob"].to_pylist(), strict=True)]
    values = np.concatenate(lists)
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:m] for b, m in zip(table["several"].to_pylist(), n, strict=True)]).astype(bool)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    marked = several.copy()
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    words, src = [], []
    for s, bits in zip(table["src"].to_pylist(), np.split(marked, np.cumsum(n)[:-1]), strict=True):
        if bits.any():
            packed = np.packbits(bits, bitorder="little").tobytes()
            words.append(np.frombuffer(packed.ljust(-(-len(packed) // 8) * 8, b"\0"), np.int64))
            src.append(s)
    return pa.table({"src": pa.array(src, pa.int64()), "owner": pa.array(table["owner"].to_pylist()[: len(src)], pa.int32()), "words": pa.array(words, pa.list_(pa.int64()))})


def _normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


ROW = "kind int, src long, owner int, pos int, kf long, kr long, doc_id long, n long, fp long, sha binary, k int, blob binary, several binary"
SENT = pa.schema([("kind", pa.int32()), ("src", pa.int64()), ("owner", pa.int32()), ("pos", pa.int32()), ("kf", pa.int64()), ("kr", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("sha", pa.binary()), ("k", pa.int32()), ("blob", pa.binary()), ("several", pa.binary())])


def _judged(work: Workspace, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kf, kr, doc_id, n, sha, keep_id, group_size, kept) for each row of keyed docs."""
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("row")[text_col]
    norm = _normalised(text)
    fp = F.shiftrightunsigned(F.xxhash64(norm), 64 - FP_BITS)
    rows = docs.select("kf", "kr", F.col("row")[id_col].cast("long").alias("doc_id"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n"), fp.alias("fp"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    sent = work.write(rows.mapInArrow(lean(_sender(owners, SENT)), ROW), "sent")

    bitmaps = sent.where("kind = 1").select("src", "owner", "pos", "k", "blob", "several").groupBy("owner").applyInArrow(_owner, "src long, owner int, words array<long>")
    bitmaps = work.write(bitmaps, "bitmaps")
    held = sent.where("kind = 0").select("src", "owner", "pos", "kf", "kr", "doc_id", "n", "fp", "sha")
    marked = held.join(beside(bitmaps), ["src", "owner"], "left").select("kf", "kr", "doc_id", "n", "fp", "sha", F.expr("coalesce(bit_get(words[pos div 64], cast(pos % 64 as int)), 0) = 1").alias("suspect"))
    marked = work.write(marked, "marked")
    work.drop("sent")

    keys = work.write(marked.where("suspect").select("fp").distinct(), "keys")
    texts = docs.select(fp.alias("fp"), norm.alias("norm")).join(beside(keys), "fp", "left_semi").groupBy("fp", "norm").agg(F.count("*").alias("copies"))
    verified = texts.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "copies").groupBy("fp", "sha").agg(F.count("*").alias("texts"), F.sum("copies").alias("copies"))
    verified = verified.select("fp", "sha", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share fingerprint and SHA-256"))).otherwise(F.col("copies")).cast("long").alias("group_size"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "kr", "kf")).alias("best")
    classes = marked.where("suspect").groupBy("fp", "sha").agg(best).join(verified, ["fp", "sha"])
    classes = work.write(classes.where("group_size > 1").select("fp", "sha", F.col("best.doc_id").alias("keep_id"), F.col("best.kf").alias("keep_kf"), F.col("best.kr").alias("keep_kr"), "group_size"), "classes")

    several = F.col("group_size").isNotNull()
    suspects = join_classes(marked.where("suspect"), classes, ["fp", "sha"], "group_size", "left").select(
        "kf", "kr", "doc_id", "n", "sha", F.when(several, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce((F.col("keep_kf") == F.col("kf")) & (F.col("keep_kr") == F.col("kr")), F.lit(True)).alias("kept"),
    )
    alone = marked.where("not suspect").select("kf", "kr", "doc_id", "n", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(suspects)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, work: Workspace | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_points (code points of the original)."""
    work = work or Workspace(docs.sparkSession, "exact_dedup")
    found = _judged(work, keyed(work, docs), id_col, text_col)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), F.col("n").alias("n_points"))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    work = Workspace(docs.sparkSession, "keep_exact")
    rows = keyed(work, docs)
    gone = work.write(_judged(work, rows, id_col, text_col).where("not kept").select("kf", "kr"), "gone")
    return rows.join(beside(gone), ["kf", "kr"], "left_anti").select("row.*")
