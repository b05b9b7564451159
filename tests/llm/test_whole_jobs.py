"""What operators left out of the whole job before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import pii as P
from tickloom.llm import substring_dedup as S
from tickloom.llm import toxicity as T
from tickloom.llm.labelled import label_weights

SF = "/root/testdata/sf0.01"


def test_repeated_short_lines_are_cut():
    once, again = "Own words here.\nAll rights reserved. See LICENSE.\nCookie notice", "  all  rights reserved. See license.\nNew text. Own words here. More\ncookie notice\nOwn words here."
    seen, out = set(), []
    for text in (once, again):
        found = S.digests(text)
        cut = S.cut_of(text, {i for i, d in enumerate(found) if d in seen}, S.MIN_WORDS)
        seen |= set(found)
        out.append([text[a:z].strip() for a, z in cut])
    # the short sentence within a longer line stays
    assert out == [[], ["all  rights reserved. See license.", "cookie notice\nOwn words here."]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").persist()


def test_no_line_stays_twice(spark, docs):
    got = {r.doc_id: r.text for r in S.substring_dedup(docs).collect()}
    norm = lambda x: " ".join(x.encode().lower().decode().split())
    left, lines = [norm(x) for t in got.values() for x in (t or "").split("\n")], set()
    for r in docs.collect():
        lines |= {norm(x) for x in r.text.split("\n")}
    left = [x for x in left if x and x in lines]
    assert len(left) == len(set(left)) and docs.where(F.col("text").isNotNull()).count() == len(got)


def test_border_does_not_depend_on_how_even_the_sample_is(spark):
    r = np.random.default_rng(3)
    z = np.concatenate([r.normal(-1, 1, 45_000), r.normal(1, 1, 5_000)])
    y = np.repeat([0, 1], [45_000, 5_000])
    whole = T._threshold(z, y, 0.0)
    even = np.concatenate([r.choice(45_000, 4_000, replace=False), 45_000 + r.choice(5_000, 4_000, replace=False)])
    assert abs(T._threshold(z[even], y[even], 0.0, (45_000 / 4_000, 5_000 / 4_000)) - whole) < 0.2 < whole - T._threshold(z[even], y[even], 0.0)
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    n = [known.where(F.col("toxic") == k).count() for k in (0, 1)]
    assert label_weights(labels, "toxic", 100) == (n[0] / 50, n[1] / 50) and label_weights(labels, "toxic", 10_000) == (1.0, 1.0)


def _surrogates(spark, texts):
    got = {r.doc_id: r for r in P.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return {(e.type, t[e.start : e.start + e.length]): e.surrogate for i, t in enumerate(texts) for e in got[i].entities}


def test_addresses_with_leading_zeros_stay_apart(spark):
    old = ["10.0.0.1", "10.0.0.01", "1.2.3.4", "1.2.3.04", "01.02.03.04", "00.00.0.0", "0.0.0.0"]
    new = _surrogates(spark, [f"from {x} on" for x in old])
    assert len(new) == len(old) == len(set(new.values()))
    form = lambda x: [len(o) if len(o) > 1 and o[0] == "0" else 0 for o in x.split(".")]
    assert all(form(a) == form(b) and all(int(o) < 256 for o in b.split(".")) for (_, a), b in new.items())
    every = spark.range(100_000).select(F.format_string("0%d.%d.0%d.%d", F.col("id") % 10, F.floor(F.col("id") / 10) % 10, F.floor(F.col("id") / 100) % 10, F.floor(F.col("id") / 1000)).alias("e"))
    assert every.select(P.surrogate(F.col("e"), F.lit("ip"))).distinct().count() == 100_000


def test_entities_that_share_a_surrogate_get_others(spark, monkeypatch):
    plain = P.surrogate
    # under the first key, all of them look like the first
    monkeypatch.setattr(P, "surrogate", lambda e, k, key=P.KEY: plain(F.when(e.isin("b@x.org", "c@x.org"), "a@x.org").otherwise(e) if key == P.KEY else e, k, key))
    texts = ["c@x.org and b@x.org", "a@x.org", "b@x.org; d@x.org", "no entity", None]
    new = _surrogates(spark, texts[:3])
    assert len(new) == 4 and len(set(new.values())) == 4
    rows = P.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 5 and {r.doc_id: r.text for r in rows}[0] == f"{new['email', 'c@x.org']} and {new['email', 'b@x.org']}"
