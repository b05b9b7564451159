"""Substring deduplication by hashed lines (operator 9).

Units are lines, and within a line the stretches that end in . ! or ? before white space or stand before a capital:
passages that were pasted into the middle of a line would otherwise share no unit with their other occurrences.
Units are normalised (A-Z lower-cased, white space to one blank) and digested to 128 bits. The first 64 bits of all
documents' units are counted; those that stand more than once are grouped by all 128, and the occurrence with the smallest (id, text hash, place) stays. Of the others, whole lines are cut out whatever their
length; lines count against lines only. Of units that stand in other lines, runs of neighbouring ones with MIN_WORDS words
or more together are cut out, so common short sentences within longer lines stay. Spans are offsets in the original text.

Defined results: null ids come first in the ranking; null texts stay null and have no units; rows that repeat both id
and text are one document and get the same result. An empty table gives no rows. Other columns are not looked at and may
have any names. min_words=1 cuts every repeated piece, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Workspace, bounded_batches, hashed, join_classes
from tickloom.llm.worker import lean

MIN_WORDS = 25
#: Texts in one Arrow batch that goes back.
SLICE = 128
#: Sets digests of whole lines apart from those of units.
LINE = 0x5DEECE66D
HALF = (1 << 64) - 1
_BREAK = regex.compile(r"\n+|(?<=[.!?])[^\S\n]+|[^\S\n]+(?=\p{Lu})")


def digest(words: list[bytes]) -> int:
    return xxhash.xxh3_128_intdigest(b" ".join(words))


def units(text: str) -> list[tuple[int, int, int, int]]:
    """(digest, words, start, end) of the units of a text that have words."""
    out, start = [], 0
    for m in _BREAK.finditer(text):
        _unit(text, start, m.start(), out)
        start = m.end()
    _unit(text, start, len(text), out)
    return out


def _unit(text: str, start: int, end: int, out: list) -> None:
    if words := text[start:end].encode("utf-8", "surrogatepass").lower().split():
        out.append((digest(words), len(words), start, end))


def lines(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(digest, first unit, unit behind the last) of the lines of a text that have words."""
    out, first = [], 0
    for i in range(1, len(found) + 1):
        if i < len(found) and "\n" not in text[found[i - 1][3] : found[i][2]]:
            continue
        whole = found[first][0] if i - first == 1 else digest(text[found[first][2] : found[i - 1][3]].encode("utf-8", "surrogatepass").lower().split())
        out.append((whole ^ LINE, first, i))
        first = i
    return out


def digests(text: str) -> list[int]:
    """Of the units, then of the lines."""
    found = units(text)
    return [u[0] for u in found] + [x[0] for x in lines(text, found)]


def removed(found: list[tuple[int, int, int, int]], marked: set[int], least: int, whole: set[int] = frozenset()) -> list[tuple[int, int]]:
    """Spans of runs of marked units with enough words, and of the units of whole lines."""
    cut, run = set(whole), []
    for i in range(len(found) + 1):
        if i < len(found) and i in marked:
            run.append(i)
            continue
        if run and sum(found[k][1] for k in run) >= least:
            cut.update(run)
        run = []
    spans = []
    for i in sorted(cut):
        if i - 1 in cut:
            spans[-1] = (spans[-1][0], found[i][3])
        else:
            spans.append((found[i][2], found[i][3]))
    return spans


def cut_of(text: str, marks: set[int], least: int) -> list[tuple[int, int]]:
    """Spans to remove, by the places of marked digests."""
    found = units(text)
    whole = {i for k, (_, a, z) in enumerate(lines(text, found), len(found)) if k in marks for i in range(a, z)}
    return removed(found, {i for i in marks if i < len(found)}, least, whole)


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            found = [digests(t) if t else [] for t in part.column(2).to_pylist()]
            halves = [pa.array([np.array([d >> shift & HALF for d in ds], np.uint64).view(np.int64) for ds in found], pa.list_(pa.int64())) for shift in (64, 0)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *halves], names=["doc_id", "th", "d1", "d2"])


def _cutter(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                texts, spans = [], []
                for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    cut = cut_of(text, set(marks), least) if text and marks else []
                    kept, last = [], 0
                    for a, z in cut:
                        kept.append(text[last:a])
                        last = z
                    texts.append("".join(kept) + text[last:] if cut else text)
                    spans.append([{"start": a, "end": z} for a, z in cut])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "removed"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS, work: Workspace | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text (what stays), removed (spans of the original), n_removed (code points)."""
    work = work or Workspace(docs.sparkSession, "substring")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    found = work.write(texts.mapInArrow(lean(_digester), "doc_id long, th long, d1 array<long>, d2 array<long>"), "digests")
    repeated = found.select(F.explode("d1").alias("d1")).groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1")
    repeated = work.write(repeated, "repeated")
    places = found.select("doc_id", "th", F.posexplode(F.arrays_zip("d1", "d2")).alias("at", "d")).select("doc_id", "th", "at", "d.d1", "d.d2")
    places = work.write(places.join(hashed(repeated), "d1", "left_semi"), "places")
    work.drop("digests")
    first = places.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = work.write(first.select("d1", "d2", "n", F.col("first.doc_id").alias("f_id"), F.col("first.th").alias("f_th"), F.col("first.at").alias("f_at")), "first")
    again = ~(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")) & (F.col("at") == F.col("f_at")))
    marks = join_classes(places, first, ["d1", "d2"], "n").where(again).groupBy("doc_id", "th").agg(F.collect_set("at").alias("marks"))
    marks = hashed(work.write(marks.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "marks"), "marks"))
    work.drop("places")
    both = texts.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    cut = both.select("doc_id", "text", "marks").mapInArrow(lean(_cutter(min_words)), "doc_id long, text string, removed array<struct<start int, end int>>")
    return cut.withColumn("n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
