"""The pipeline's stages against brute-force versions, and the registered queries against their SQL."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from tickloom.llm import bpe as B
from tickloom.llm.common import Workspace
from tickloom.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tickloom.llm import toxicity as T

    work, docs = Workspace(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    cols, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    after = {}
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = work.write(stage(spark, docs, SF), name)
        got = after[name] = docs.collect()
        ids = [r.doc_id for r in got]
        if name == "toxicity":
            score = {r.doc_id: r.score for r in T.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), T.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)).collect()}
            assert sorted(ids) == sorted(i for i in before if score[i] < 0.5)
        elif name == "exact_dedup":
            best = {}
            for r in before.values():
                key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
                best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
            assert sorted(ids) == sorted(i for _, i in best.values())
        elif name == "near_dedup":
            from test_operators import brute_components

            comp, _, _ = brute_components([(r.doc_id, r.text) for r in before.values()], 5, 80)
            assert sorted(ids) == sorted(i for i, c in comp.items() if i == c)
        elif name == "mixing":
            assert set(ids) <= set(before) and max(ids.count(i) for i in set(ids)) <= 3
            assert all(r == before[r.doc_id] for r in got)
        else:
            model = B.Bpe(open(B.default_path(), encoding="utf-8").read())
            assert len(ids) == len(after["mixing"])
            assert all(r.ids == model.encode(before[r.doc_id].text).tolist() and r.n_tokens == len(r.ids) for r in got)
        assert docs.columns == (cols if name != C.STAGES[-1][0] else ["doc_id", "source", "n_tokens", "ids"])
    assert sorted(map(tuple, C.run(spark, SF).collect()), key=repr) == sorted(map(tuple, after["encoding"]), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = entry.queries()[name](spark, SF), con.sql(ORACLES[name])
    got, want, names = df.collect(), rel.fetchall(), rel.columns
    cols = sorted(df.columns)
    assert cols == sorted(names)
    a, b = [df.columns.index(c) for c in cols], [names.index(c) for c in cols]
    assert sorted(repr([r[i] for i in a]) for r in got) == sorted(repr([r[i] for i in b]) for r in want)


@pytest.mark.parametrize("name", ["op1_quality", "op3_pii_surrogates", "op4_bpe", "op5_jaccard_join", "op7_toxicity", "op9_substring_dedup"])
def test_query_has_a_row_a_document(name, spark):
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
