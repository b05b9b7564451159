"""Exact n-gram Jaccard join and its connected components (operator 5).

Sets of word shingles go to tiles of neighbouring size bands. Two sets that link must share many of their smallest
hashes, so each set publishes those: partitions send sorted Golomb-coded fingerprints to owners, which answer how many
sets hold each. A set too few of whose published shingles stand elsewhere links with nothing. Of the others, the
rarest are postings: sets that link share one in a tile. Sets that share a posting, directly or through others, form a
candidate family. A family that fits a task is compared there; a larger one in blocks of its size bands or, where sets
have fewer postings than there are blocks (as in long chains of sets that each share something with the next), in the
cells of one tile and posting, the large ones in blocks. In a block, bit counts of hashed bitmaps bound the overlap from
above, and the survivors' sorted arrays are intersected. Blocks only give the links that join what wasn't joined,
never all pairs; equal sets, known by 128 bits, are one class throughout.

Defined results: texts without words (or null) have no shingles and link with nothing, so their component is their
own id; null ids stand in no minimum; rows that repeat a text are one class. An empty table gives no rows. Other columns
are not looked at and may have any names.
m sets that share one posting in one size band cost up to m * m / 2 bit counts: the exact worst case of sets that nearly link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Workspace, beside, bounded_batches, components, hashed, join_classes, keyed
from tickloom.llm.exact_dedup import FP_BITS, golomb_decode, golomb_encode
from tickloom.llm.shingles import band_of, bands, mix, shingle_set
from tickloom.llm.worker import lean

#: Shingles and sets in a block; bounds a task's memory and time, not the result.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 4096
#: Texts in one Arrow batch that goes back, and published shingles that a partition codes at a time.
SLICE, CHUNK = 256, 500_000
#: Fingerprint ranges for each shuffle partition: one range is what a task holds at a time.
OWNERS = 4
#: Per cent of a set that it publishes beyond what a link leaves room to differ in.
EXTRA = 10


def published(n: int, num: int, den: int) -> tuple[int, int]:
    """(smallest hashes that a set of n shows, how many of them it must share with a set that it links with).

    Sets x and y that link share den * overlap >= num * max(n) shingles, hence, for any j up to that, j of the
    n - ceil(num n / den) + j smallest of each. Here j is EXTRA of the size, of the smaller of the two for both.
    """
    part = lambda m: -(-m * EXTRA // 100)
    least = -(-n * num // den)
    return min(n, n - least + part(n)), part(least)


SENT = pa.schema([("kind", pa.int32()), ("src", pa.int64()), ("owner", pa.int32()), ("kf", pa.int64()), ("kr", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("idx", pa.int32()), ("m", pa.int64()), ("k", pa.int32()), ("blob", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])
SENT_SQL = "kind int, src long, owner int, kf long, kr long, doc_id long, th long, n long, k1 long, k2 long, idx int, m long, k int, blob binary, counts binary, docs binary"


def _batch(got: dict, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if f.name in got else pa.nulls(size, f.type) for f in SENT], schema=SENT)


def _publisher(width: int, num: int, den: int, owners: int):
    """Rows with their place in their chunk (kind 0), and each owner's sorted fingerprints of the chunk (kind 1)."""

    def lists(src: int, shown: list[np.ndarray]) -> pa.RecordBatch:
        fp = (np.concatenate(shown) >> np.uint64(64 - FP_BITS)).astype(np.int64)
        doc = np.repeat(np.arange(len(shown), dtype=np.uint16), [len(x) for x in shown])
        order = np.argsort(fp, kind="stable")
        fp, doc = fp[order], doc[order]
        edges = np.searchsorted((fp >> (FP_BITS - 24)) * owners >> 24, np.arange(owners + 1))
        got: dict[str, list] = {x: [] for x in ("kind", "src", "owner", "m", "k", "blob", "counts", "docs")}
        for o in range(owners):
            part = slice(edges[o], edges[o + 1])
            if edges[o] == edges[o + 1]:
                continue
            values, counts = np.unique(fp[part], return_counts=True)
            k, blob = golomb_encode(values)
            for name, x in (("kind", 1), ("src", src), ("owner", o), ("m", len(values)), ("k", k), ("blob", blob), ("counts", zlib.compress(np.minimum(counts, 65535).astype(np.uint16).tobytes(), 1)), ("docs", doc[part].tobytes())):
                got[name].append(x)
        return _batch(got, len(got["src"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        src, shown, held = TaskContext.get().partitionId() << 20, [], 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                got: dict[str, list] = {x: [] for x in ("kind", "src", "n", "k1", "k2", "idx", "m")}
                for text in part.column(4).to_pylist():
                    s = shingle_set(text, width)
                    key = xxhash.xxh3_128_intdigest(s.tobytes())
                    most = published(len(s), num, den)[0]
                    for name, x in (("kind", 0), ("src", src), ("n", len(s)), ("k1", int(np.uint64(key >> 64).astype(np.int64))), ("k2", int(np.uint64(key & (1 << 64) - 1).astype(np.int64))), ("idx", len(shown)), ("m", most)):
                        got[name].append(x)
                    shown.append(s[:most])
                    held += most
                    if held >= CHUNK or len(shown) == 65535:
                        if held:
                            yield lists(src, shown)
                        src, shown, held = src + 1, [], 0
                yield _batch(got | {c: part.column(i).to_pylist() for i, c in enumerate(("kf", "kr", "doc_id", "th"))}, part.num_rows)
        if held:
            yield lists(src, shown)

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """To each list of this range, how many sets hold each of its fingerprints."""
    m = table["m"].to_pylist()
    values = np.concatenate([golomb_decode(k, n, b) for k, n, b in zip(table["k"].to_pylist(), m, table["blob"].to_pylist(), strict=True)])
    counts = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint16) for x in table["counts"].to_pylist()]).astype(np.int64)
    _, back = np.unique(values, return_inverse=True)
    total = np.minimum(np.bincount(back, weights=counts)[back], 65535).astype(np.uint16)
    answers = [zlib.compress(x.tobytes(), 1) for x in np.split(total, np.cumsum(m)[:-1])]
    return pa.table({"kind": pa.array([2] * len(m), pa.int32()), "src": table["src"].combine_chunks(), "owner": table["owner"].combine_chunks(), "counts": pa.array(answers, pa.binary())})


def _postings(num: int, den: int):
    """(k1, posting) of the sets of one chunk that may link: their rarest published shingles, in both their tiles."""

    def run(table: pa.Table) -> pa.Table:
        rows = {k: table.filter(pa.compute.equal(table["kind"], k)) for k in range(3)}
        answer = dict(zip(rows[2]["owner"].to_pylist(), rows[2]["counts"].to_pylist(), strict=True))
        fps, sets, docs = [], [], []
        for o, k, m, blob, counts, doc in zip(*(rows[1][c].to_pylist() for c in ("owner", "k", "m", "blob", "counts", "docs")), strict=True):
            here = np.frombuffer(zlib.decompress(counts), np.uint16)
            fps.append(np.repeat(golomb_decode(k, m, blob), here))
            sets.append(np.repeat(np.frombuffer(zlib.decompress(answer[o]), np.uint16), here))
            docs.append(np.frombuffer(doc, np.uint16))
        k1_out, key_out = [], []
        if fps:
            fp, df, doc = np.concatenate(fps), np.concatenate(sets), np.concatenate(docs)
            shared = df > 1
            fp, df, doc = fp[shared], df[shared], doc[shared]
            order = np.lexsort((fp, df, doc))
            fp, doc = fp[order], doc[order].astype(np.int64)
            n = dict(zip(rows[0]["idx"].to_pylist(), zip(rows[0]["k1"].to_pylist(), rows[0]["n"].to_pylist(), rows[0]["m"].to_pylist(), strict=True), strict=True))
            starts = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
            for a, b in zip(starts, [*starts[1:], len(doc)][: len(starts)], strict=True):
                k1, size, shown = n[int(doc[a])]
                need = published(size, num, den)[1]
                if b - a < need:
                    continue
                rare = fp[a : min(b, a + (shown - need + 1) - (shown - (b - a)))].astype(np.uint64)
                band = band_of(size, num, den)
                for tile in (band, band + 1):
                    key_out.append(mix(mix(rare) + np.uint64(tile)))
                    k1_out.append(np.full(len(rare), k1, np.int64))
        whole = lambda xs: np.concatenate(xs).view(np.int64) if xs else np.zeros(0, np.int64)
        return pa.table({"k1": whole(k1_out), "sig": whole(key_out)})

    return run


def _sets(width: int):
    """Sorted arrays of the texts that were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                keep, sets = [], []
                for i, (text, k1, k2) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True)):
                    s = shingle_set(text, width).tobytes()
                    if xxhash.xxh3_128_intdigest(s) == ((k1 % (1 << 64)) << 64 | k2 % (1 << 64)):  # else another text under its hash
                        keep.append(i)
                        sets.append(s)
                got = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([got.column("comp"), got.column("cid"), got.column("n"), pa.array(sets, pa.binary())], names=["comp", "cid", "n", "items"])

    return run


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect just what all links of the sets connect."""
    size = np.array([len(s) for s in sets], np.int64)
    bits = 1 << max(8, int(4 * size.max() - 1).bit_length())
    maps = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        at = (s & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(maps[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    words = maps.view(np.uint64)
    left = np.ones(len(sets), bool)
    links = []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        reached = [first]
        while reached:
            i = reached.pop()
            near = np.flatnonzero(left & (size * den >= size[i] * num) & (size * num <= size[i] * den))
            if not len(near):
                continue
            both = size[near] + size[i]
            most = (both - np.bitwise_count(words[near] ^ words[i]).sum(1, dtype=np.int64)) // 2
            for j in near[den * most >= num * (both - most)].tolist():
                a, b = sets[i], sets[j]
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if den * shared >= num * (len(a) + len(b) - shared):
                    links.append((i, j))
                    left[j] = False
                    reached.append(j)
    return links


def _block(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        cell, cid = table["cell"].to_numpy(), table["cid"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        a, b = [], []
        order = np.argsort(cell, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            for i, j in spanning_links([sets[r] for r in rows], num, den):
                a.append(int(cid[rows[i]]))
                b.append(int(cid[rows[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _candidates(work: Workspace, texts: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their sets' size and key, postings, families): written tables."""
    owners = OWNERS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = work.write(texts.mapInArrow(lean(_publisher(width, num, den, owners)), SENT_SQL), "sent")
    lists = sent.where("kind = 1")
    answers = lists.select("src", "owner", "m", "k", "blob", "counts").groupBy("owner").applyInArrow(_frequencies, "kind int, src long, owner int, counts binary")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("idx", "int"), ("k1", "long"), ("n", "long"), ("m", "long"), ("k", "int"), ("blob", "binary"), ("docs", "binary"))]
    cols = ["kind", "src", "owner", "counts", "idx", "k1", "n", "m", "k", "blob", "docs"]
    told = sent.where("kind < 2 and (kind = 1 or n > 0)").select(*cols).union(answers.select("kind", "src", "owner", "counts", *empty))
    postings = work.write(told.groupBy("src").applyInArrow(_postings(num, den), "k1 long, sig long"), "postings")

    shared = postings.groupBy("sig").agg(F.min("k1").alias("hub"), F.max("k1").alias("other")).where("hub <> other").select("sig", "hub")
    shared = work.write(shared, "shared")
    # A set's hubs belong to its least hub: so a set gives one edge of its own, and the rest are edges among few hubs.
    hubs = postings.join(hashed(shared), "sig").groupBy("k1").agg(F.min("hub").alias("low"), F.collect_set("hub").alias("hubs"))
    ends = F.array_union(F.array("k1"), F.col("hubs"))
    edges = hubs.select(F.explode(ends).alias("a"), F.col("low").alias("b"))
    families = work.write(components(work, edges, "family"), "families")
    work.drop("shared")
    return sent.where("kind = 0").select("kf", "kr", "doc_id", "th", "n", "k1", "k2"), postings, families


def _tasks(work: Workspace, classes: DataFrame, sets: DataFrame, postings: DataFrame, num: int, den: int) -> DataFrame:
    """(task, cell, cid, items): each set in every task that compares it; in a task, sets of a cell are compared."""
    lows = bands(1 << 24, num, den)[0]
    band = F.expr("cast(" + "+".join(f"cast(n >= {x} as int)" for x in lows.tolist()) + " as int)")
    total = (F.sum("n").alias("shingles"), F.count("*").alias("members"))
    fits = (F.col("shingles") <= BLOCK_SHINGLES) & (F.col("members") <= BLOCK_SETS)
    cut = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_SETS)).cast("int").alias("blocks")
    families = classes.groupBy("comp").agg(*total)
    packs = int(families.where(fits).agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]) // BLOCK_SHINGLES + 1
    packed = F.struct(F.lit(0).alias("way"), F.pmod(F.xxhash64(F.lit(11), "comp"), F.lit(packs)).alias("p"), F.lit(0).alias("lo"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    large = work.write(families.where(~fits).select("comp"), "large")
    if not large.limit(1).count():
        return sets.select(packed.alias("task"), F.col("comp").alias("cell"), "cid", "items")

    # Larger families: pairs of blocks of a size band or of neighbouring ones, or the cells of their postings, whichever moves fewer sets.
    mine = work.write(classes.withColumn("band", band).join(beside(large), "comp", "left_semi"), "members")
    by_band = mine.groupBy("comp", "band").agg(*total).select("comp", "band", cut, "members")
    around = by_band.select("comp", "band", "blocks").union(by_band.selectExpr("comp", "band + 1", "0")).union(by_band.selectExpr("comp", "band - 1", "0")).groupBy("comp", "band").agg(F.max("blocks").alias("blocks"))
    plan = around.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("plan"))
    moved = by_band.join(plan, "comp").groupBy("comp").agg(F.sum(F.expr("members * (plan[band] + coalesce(plan[band + 1], 0) + coalesce(plan[band - 1], 0))")).alias("by_blocks"))
    held = postings.join(mine.select("k1", "comp", "cid", "n"), "k1")
    by_cells = held.groupBy("comp").agg(F.count("*").alias("by_cells"))
    way = work.write(plan.join(moved, "comp").join(by_cells, "comp", "left").selectExpr("comp", "plan", "coalesce(by_cells < by_blocks, false) as cells"), "way")
    in_cells = way.where("cells").select("comp")

    own = F.expr("cast(pmod(xxhash64(cid, 7), plan[band]) as int)")
    blocks = F.expr("""concat(
        transform(sequence(0, plan[band] - 1), x -> struct(1 as way, comp as p, band as lo, least(x, own) as i, greatest(x, own) as j)),
        if(coalesce(plan[band + 1], 0) < 1, array(), transform(sequence(0, plan[band + 1] - 1), x -> struct(1 as way, comp as p, band as lo, own as i, -2 - x as j))),
        if(coalesce(plan[band - 1], 0) < 1, array(), transform(sequence(0, plan[band - 1] - 1), x -> struct(1 as way, comp as p, band - 1 as lo, x as i, -2 - own as j))))""")
    dealt = sets.withColumn("band", band).join(beside(way), "comp", "left")
    small = dealt.where("plan is null").select(packed.alias("task"), F.col("comp").alias("cell"), "cid", "items")
    in_blocks = dealt.where("not cells").withColumn("own", own).select(F.explode(blocks).alias("task"), F.col("comp").alias("cell"), "cid", "items")
    out = small.union(in_blocks)
    if not in_cells.limit(1).count():
        return out
    held = work.write(held.join(beside(in_cells), "comp", "left_semi").select("sig", "cid", "n"), "held")
    cells = held.groupBy("sig").agg(*total).where("members > 1").select("sig", cut, "shingles")
    cells = work.write(cells, "cells")
    cell_packs = int(cells.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]) // BLOCK_SHINGLES + 1
    split = F.expr(f"""if(blocks = 1, array(struct(2 as way, pmod(sig, {cell_packs}) as p, 0 as lo, -1 as i, -1 as j)),
        transform(sequence(0, blocks - 1), x -> struct(3 as way, sig as p, 0 as lo, least(x, own) as i, greatest(x, own) as j)))""")
    placed = held.join(beside(cells.select("sig", "blocks")), "sig").withColumn("own", F.expr("cast(pmod(xxhash64(cid, 7), blocks) as int)"))
    placed = placed.select(F.explode(split).alias("task"), F.col("sig").alias("cell"), "cid").distinct()
    return out.union(placed.join(dealt.where("cells").select("cid", "items"), "cid").select("task", "cell", "cid", "items"))


def _judged(work: Workspace, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, kf, kr, n, component_id, stays) for each row of keyed docs: of a component, one row stays."""
    bounded_batches(docs.sparkSession)
    text = F.col("row")[text_col]
    texts = docs.select("kf", "kr", F.col("row")[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    held, postings, families = _candidates(work, texts, width, num, den)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "kr", "kf")).alias("best")
    known = work.write(held.where("n > 0").groupBy("k1", "k2").agg(F.first("n").alias("n"), F.min("th").alias("th"), best, F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "known")
    classes = work.write(known.join(hashed(families), F.col("k1") == F.col("v")).select("k1", "k2", "comp", "n", "th", "cid"), "classes")
    wanted = work.write(classes.select("th").distinct(), "wanted")
    found = texts.select("th", "text").join(beside(wanted), "th", "left_semi").distinct()
    sets = work.write(found.join(hashed(classes), "th").select("text", "comp", "cid", "k1", "k2", "n").mapInArrow(lean(_sets(width)), "comp long, cid long, n long, items binary"), "sets")
    tasks = _tasks(work, classes, sets, postings, num, den)
    links = tasks.groupBy("task").applyInArrow(_block(num, den), "a long, b long")
    linked = work.write(components(work, links, "linked"), "roots")
    for name in ("postings", "sets", "members", "held", "cells"):
        work.drop(name)

    groups = known.join(linked, F.col("cid") == F.col("v"), "left").select("k1", "k2", "best", "copies", F.coalesce("comp", "cid").alias("root"), F.col("comp").isNotNull().alias("linked"))
    first = groups.where("linked").groupBy("root").agg(F.min("best").alias("first"))
    groups = groups.join(first, "root", "left").where("copies > 1 or linked").select("k1", "k2", "copies", F.coalesce("first", "best").alias("first"))
    groups = work.write(groups.select("k1", "k2", "copies", F.col("first.doc_id").alias("least"), F.col("first.kf").alias("f_kf"), F.col("first.kr").alias("f_kr")), "groups")
    rows = held.select("doc_id", "kf", "kr", "n", "k1", "k2")
    out = join_classes(rows.where("n > 0"), groups, ["k1", "k2"], "copies", "left").select(
        "doc_id", "kf", "kr", "n", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce((F.col("f_kf") == F.col("kf")) & (F.col("f_kr") == F.col("kr")), F.lit(True)).alias("stays")
    )
    return out.union(rows.where("n = 0").select("doc_id", "kf", "kr", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, num: int = 90, den: int = 100, work: Workspace | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id. Sets link when den * intersection >= num * union."""
    work = work or Workspace(docs.sparkSession, "jaccard")
    found = _judged(work, keyed(work, docs), id_col, text_col, width, num, den)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, null ids last; rows with no words stay."""
    work = Workspace(docs.sparkSession, "keep_near")
    rows = keyed(work, docs)
    gone = work.write(_judged(work, rows, id_col, text_col, width, num, den).where("not stays").select("kf", "kr"), "gone")
    return rows.join(beside(gone), ["kf", "kr"], "left_anti").select("row.*")
