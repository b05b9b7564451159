"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import bpe as B
from tickloom.llm import embedding_dedup as E
from tickloom.llm import exact_dedup as D
from tickloom.llm import jaccard_join as J
from tickloom.llm import mixing as M
from tickloom.llm import pii as P
from tickloom.llm import quality as Q
from tickloom.llm import substring_dedup as S
from tickloom.llm import toxicity as T
from tickloom.llm import url_filter as U
from tickloom.llm.common import Workspace, components
from tickloom.llm.labelled import sample
from tickloom.llm.shingles import bands, shingle_set

SF = "/root/testdata/sf0.01"
ODD = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (2, None, 6), (3, "", 7), (None, "A b c d e f", 8), (4, "x", 9), (5, " \n\t ", 1), (6, "long " * 30_000, 2)]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use themselves."""
    rows = [(i, t, k, "s", "z", float(k)) for i, t, k in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, th long, source string, kind string, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


def union_find(pairs, ids):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# shared pieces


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(1, 300), r.randint(1, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    want = {k: v for k, v in union_find(edges, {x for e in edges for x in e}).items() if any(k in e and e[0] != e[1] for e in edges)}
    got = components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "c").collect()
    assert {r.v: r.comp for r in got} == want and len(got) == len(want)
    assert not components(Workspace(spark, "test"), spark.createDataFrame([], "a long, b long"), "c").count()


# exact copies


@given(st.lists(st.integers(0, (1 << D.FP_BITS) - 1), max_size=300, unique=True))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.int64)
    assert (D.golomb_decode(*(lambda k, b: (k, len(v), b))(*D.golomb_encode(v))) == v).all()


def test_exact_dedup(spark, docs):
    p = docs.select("doc_id", "text").toPandas()
    p["sha"] = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest() for t in p.text]
    p["n"] = p.text.str.len()
    p = p.sort_values(["n", "doc_id"], ascending=[False, True])
    want = {r.doc_id: r for r in p.assign(keep=p.groupby("sha").doc_id.transform("first"), size=p.groupby("sha").doc_id.transform("size")).itertuples()}
    got = D.exact_dedup(docs).collect()
    assert len(got) == len(want)
    assert all((r.keep_id, r.group_size, r.text_sha256, r.kept) == (want[r.doc_id].keep, want[r.doc_id].size, want[r.doc_id].sha, r.doc_id == want[r.doc_id].keep) for r in got)
    assert D.keep_exact(docs).count() == sum(r.kept for r in got)


def test_exact_dedup_odd_rows(spark):
    got = D.exact_dedup(odd(spark)).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == 5
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {(2, 5, 3), (3, 5, 3), (5, 5, 3)}
    kept = D.keep_exact(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 5
    assert not D.exact_dedup(odd(spark).limit(0)).count() and not D.keep_exact(odd(spark).limit(0)).count()


# near copies


def brute_components(rows, width, num):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t in rows}
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for i, w in words.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return union_find(links, sets), {i: len(s) for i, s in sets.items()}, len(links)


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (2, 60)])
@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, width, num, small):
    r = random.Random(width)
    if small:
        monkeypatch.setattr(J, "BLOCK_SETS", 8)
        monkeypatch.setattr(J, "BLOCK_SHINGLES", 900)
        monkeypatch.setattr(J, "CHUNK", 500)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 8, 20, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(260):
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 12))):
            w[r.randrange(len(w))] = f"n{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w).replace("w1", "W1")))
    rows += [(900 + k, t) for k, t in enumerate(["", None, "x", "X", "x y", "y x"])]
    comp, size, links = brute_components(rows, width, num)
    got = {x.doc_id: x for x in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, num=num).collect()}
    assert links > 100 and {i: g.component_id for i, g in got.items()} == comp and {i: g.n_shingles for i, g in got.items()} == size


def test_published_shingles_suffice():
    """For sets that link: the shown parts share what is asked of both, whatever the sizes."""
    r = random.Random(1)
    for num in (60, 80, 90):
        for _ in range(400):
            n = r.randint(1, 120)
            x = {r.getrandbits(64) for _ in range(n)}
            y = set(r.sample(sorted(x), r.randint(max(1, n * num // 100), n))) | {r.getrandbits(64) for _ in range(r.randint(0, n // 8))}
            if 100 * len(x & y) < num * len(x | y):
                continue
            shown = [set(sorted(s)[: J.published(len(s), num, 100)[0]]) for s in (x, y)]
            assert len(shown[0] & shown[1]) >= max(J.published(len(s), num, 100)[1] for s in (x, y))
            low = bands(1 << 10, num, 100)[0]
            assert abs(int(np.searchsorted(low, len(x), "right")) - int(np.searchsorted(low, len(y), "right"))) <= 1


def test_shingles():
    assert len(shingle_set("a b c a b c", 3)) == 3 and len(shingle_set("a b", 3)) == 1 and not len(shingle_set(" \x0b\n", 3))
    assert (shingle_set("A b C", 3) == shingle_set("a B\tc", 3)).all() and (shingle_set("É b c", 3) != shingle_set("é b c", 3)).all()
    assert (shingle_set("a b", 3) != shingle_set("a b b", 3)).all()


def test_jaccard_odd_rows(spark):
    got = J.jaccard_components(odd(spark)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 4, 1), (1, 4, 1), (1, 4, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 0, 5), (6, 1, 6)]
    assert J.keep_near(odd(spark)).columns == odd(spark).columns
    assert not J.jaccard_components(odd(spark).limit(0)).count()


# encoding


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    return B.Bpe(open(B.default_path(), encoding="utf-8").read()), Tokenizer.from_file(B.default_path())


@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aBé 'll's<|endoftext|>\n\x1c ßΣ9²")), max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_the_library(coders, text):
    mine, ref = coders
    ids = mine.encode(text).tolist()
    assert ids == ref.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == ref.decode(ids, skip_special_tokens=False)


def test_bpe_long_words_and_added_tokens(coders):
    mine, ref = coders
    for text in ("ab" * 3000, "x" * 5000, "a<|endoftext|>b <|startoftext|>", "mississippi" * 40, ""):
        assert mine.encode(text).tolist() == ref.encode(text, add_special_tokens=False).ids


def test_bpe_odd_rows(spark, coders):
    got = B.bpe(odd(spark), keep=("source", "kind")).collect()
    assert len(got) == len(ODD) and {len(r.ids) for r in got if r.doc_id in (2, 3, 5)} == {0}
    assert all(r.decoded == coders[1].decode(r.ids, skip_special_tokens=False) for r in got)
    assert not B.bpe(odd(spark).limit(0)).count()


# classifiers


def auc(z, y):
    order = np.argsort(z, kind="stable")
    rank = np.empty(len(z))
    rank[order] = np.arange(len(z))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


@pytest.mark.parametrize(("module", "label", "least"), [(T, "toxic", 0.95), (Q, "quality", 0.95)])
def test_classifier_on_held_out_rows(spark, module, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    known = docs.join(labels, "doc_id").where((F.crc32(F.col("doc_id").cast("string")) % 5) == 0)
    scored = (T.toxicity if module is T else Q.quality)(known, model).join(labels, "doc_id").select("score", label).toPandas()
    y, z, border = scored[label].to_numpy(), scored.score.to_numpy(), 0.5 if module is T else Q.BORDER
    assert auc(z, y) > least
    said = z >= border
    assert (said & (y == 1)).sum() / (y == 1).sum() > 0.9 and (said & (y == 0)).sum() / (y == 0).sum() < 0.04


def test_samples_leave_out_held_out_rows(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = sample(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("y")), "y", 60)
    assert len(got) == 60 and sum(y for _, y in got) == 30 and all(zlib.crc32(t.encode()) % 5 for t, _ in got)


@pytest.mark.parametrize("module", [T, Q])
def test_classifier_odd_rows(spark, module):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert module.fit(odd(spark), none, "toxic") is None
    score = T.toxicity if module is T else Q.quality
    assert score(odd(spark), None).count() == len(ODD)
    model = module.train([("fine words here\n" * 3, 1), ("bad !!! ###\n" * 3, 0)] * 40)
    got = {r.doc_id: r.score for r in score(odd(spark), model).collect()}
    assert len(got) == 7 and all(0 <= v <= 1 for v in got.values()) and got[2] == got[3]
    assert not score(odd(spark).limit(0), model).count()
    if module is T:
        assert T.keep_clean(odd(spark), model).columns == odd(spark).columns


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(1)
    crf = Q.Crf(np.zeros((len(Q.MEASURES), Q.BINS - 1)), trans=r.normal(size=(2, 2)))
    scores = [r.normal(size=n) for n in (1, 4, 6, 2)]
    good, pairs = crf.marginals(scores)
    total = np.zeros((2, 2))
    for s, g in zip(scores, good, strict=True):
        weight, mine, both = 0.0, np.zeros(len(s)), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=len(s)):
            w = np.exp(sum(x * p for x, p in zip(s, path, strict=True)) + sum(crf.trans[a, b] for a, b in itertools.pairwise(path)))
            weight += w
            mine += w * np.array(path)
            for a, b in itertools.pairwise(path):
                both[a, b] += w
        assert np.allclose(g, mine / weight)
        total += both / weight
    assert np.allclose(pairs, total)


def test_filters_over_pieces_equal_one_pass():
    m = T.TextCnn(np.random.default_rng(2))
    docs = [np.random.default_rng(i).normal(size=(n, T.DIM)).astype(np.float32) for i, n in enumerate((0, 1, 2, 50, 40_000))]
    got = m.pooled(docs)
    for d, g in zip(docs, got, strict=True):
        x = np.vstack([d, np.zeros((max(T.WIDTHS) - 1, T.DIM), np.float32)])
        want = np.maximum(m.responses(x).max(0) + m.conv_b, 0) if len(d) else np.zeros(len(g))
        assert np.allclose(g, want, atol=1e-4)


# urls


def test_url_filter(spark):
    urls = {
        "https://www.Example.com/en/x?casino": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://x.org/casino/": ("x.org", "/casino/", None, "block"), "http://x.org/casinos/": ("x.org", "/casinos/", None, "allow"), "http://free.x.org/a#bets": ("free.x.org", "/a", None, "block"),
        "http://free.x.org/free": ("free.x.org", "/free", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "ftp://b.net/es/": ("b.net", "/es/", "net/es/", "block"), "http://com": ("com", "", None, "allow"), "a://b?://c": ("b", "", None, "allow"), "http://xcom/": ("xcom", "/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, id string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_filter(pages).collect()}
    assert got == dict(enumerate(urls.values()))
    assert not U.url_filter(pages.limit(0)).count()


# embeddings


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_components(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 24))
    x = [base[i % 12] + r.normal(size=24) * r.choice([0, 0.02, 0.12, 0.3]) for i in range(260)]
    rows = [(i, [float(np.float32(v)) for v in e], i % 2) for i, e in enumerate(x)]
    links = set()
    for a, b in itertools.combinations(rows, 2):
        p, q = np.array(a[1], float), np.array(b[1], float)
        if a[2] == b[2] and p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
            links.add((a[0], b[0]))
    got = {g.vec_id: g for g in E.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(g.n_links for g in got.values()) >= 0.999 * 2 * len(links) and sum(g.n_links for g in got.values()) <= 2 * len(links)
    assert {i: g.component_id for i, g in got.items()} == union_find(links, range(260))


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, 0.01], 1), (6, [1.0, 0.0], None), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [1.0, -0.0], 2), (10, [], 1)]
    v = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, cid int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_components(v).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 1, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)]
    assert not E.embedding_components(v.limit(0)).count()


# repeated passages


def test_substring_dedup(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    sentence = lambda n: " ".join([word().capitalize(), *[word() for _ in range(n - 1)]]) + "."
    passage = " ".join(sentence(10) for _ in range(6))
    own = {i: [" ".join(sentence(r.randint(3, 12)) for _ in range(4)) for _ in range(3)] for i in range(30)}
    text = {i: f"{o[0]}\n{o[1]} lead in {passage} {o[2]}" if i % 3 == 0 else "\n".join(o) for i, o in own.items()}
    got = {x.doc_id: x for x in S.substring_dedup(spark.createDataFrame(sorted(text.items()), "doc_id long, text string")).collect()}
    seen = set()
    for i in sorted(text):
        units = S.units(text[i])
        marked = {k for k, u in enumerate(units) if u[0] in seen}
        seen |= {u[0] for u in units}
        assert [(x.start, x.end) for x in got[i].removed] == S.removed(units, marked, S.MIN_WORDS)
        assert (passage in got[i].text) == (i == 0) and (i % 3 == 0 or got[i].text == text[i])
        kept, at = [], 0
        for x in got[i].removed:
            kept.append(text[i][at : x.start])
            at = x.end
        assert got[i].text == "".join(kept) + text[i][at:] and got[i].n_removed == len(text[i]) - len(got[i].text)


def test_substring_odd_rows(spark):
    got = S.substring_dedup(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.text is None for r in got if r.doc_id == 2)
    assert not S.substring_dedup(odd(spark).limit(0)).count()


# personal data


def test_surrogates(spark):
    texts = ["Mail a.b@x.org, A.B@x.org and cd9@y.net; call +1 (974) 555-3436 or 212-555-0100.", "Mr. Adam Weber met Mrs. Anna Schmidt. Mr. Adam Weber paid 4111 1111 1111 1111 from 10.0.0.1 (not 300.1.1.1).", "Mr. Иван Петров 123-45-6789 DE89 3704 0044 0532 0130 00 04dbebab91ab85687d33eeaaf9ac699e1188f962", "a.b@x.org again"]
    got = {r.doc_id: r for r in P.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    moved, kinds = {}, {}
    for i, t in enumerate(texts):
        out, at = [], 0
        for e in got[i].entities:
            old = t[e.start : e.start + e.length]
            assert moved.setdefault((e.type, old), e.surrogate) == e.surrogate
            assert e.type in ("ip", "name", "secret") or [c.isdigit() for c in old] == [c.isdigit() for c in e.surrogate]
            kinds[e.type] = kinds.get(e.type, 0) + 1
            out.append(t[at : e.start] + e.surrogate)
            at = e.start + e.length
        assert got[i].text == "".join(out) + t[at:]
    assert kinds == {"email": 4, "phone": 2, "name": 4, "card": 1, "ip": 1, "ssn": 1, "iban": 1, "secret": 1}
    assert len(set(moved.values())) == len(moved) and all(k[1] != v for k, v in moved.items())
    first = {k[1].split()[0]: v.split()[0] for k, v in moved.items() if k[0] == "name"}
    assert first["Adam"] in P.NAMES["m", "latin"] and first["Anna"] in P.NAMES["f", "latin"] and first["Иван"] in P.NAMES["m", "cyrillic"]
    card = [int(c) for c in next(v for k, v in moved.items() if k[0] == "card") if c.isdigit()]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(card)) % 10 == 0


def test_surrogates_are_bijections(spark):
    n = spark.range(20_000)
    ip = n.select(F.concat_ws(".", *[(F.floor(F.col("id") / k) % 256).cast("string") for k in (16_777_216, 65_536, 256, 1)]).alias("e"), F.lit("ip").alias("k"))
    phone = n.select(F.format_string("+1 (%03d) %03d-0000", F.floor(F.col("id") / 1000), F.col("id") % 1000).alias("e"), F.lit("phone").alias("k"))
    mail = n.select(F.concat(F.conv(F.col("id") + 1000, 10, 36), F.lit("@x.org")).alias("e"), F.lit("email").alias("k"))
    card = n.select(F.format_string("%016d", F.col("id") * 7919).alias("e"), F.lit("card").alias("k"))
    every = ip.union(phone).union(mail).union(card)
    out = every.select("k", P.surrogate(F.col("e"), F.col("k")).alias("s")).groupBy("k").agg(F.countDistinct("s").alias("n")).collect()
    assert {r.k: r.n for r in out} == dict.fromkeys(("ip", "phone", "email", "card"), 20_000)


def test_surrogates_odd_rows(spark):
    got = P.surrogates(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.n_entities == 0 for r in got) and {r.text for r in got if r.doc_id == 2} == {None}
    assert not P.surrogates(odd(spark).limit(0)).count()


# mixing


def brute_targets(sizes):
    """Shares by weight, limits cut and the excess shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, out = set(names), {}
    while left:
        rest = sum(sizes.values()) - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] >= 3 * sizes[s]}
        if not above:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in above}
        left -= above
    return out


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 200])), r.choice(["a"] * 30 + ["b", "c", "d", "é", None, "zz"])) for i in range(1500)]
    got = M.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    taken = {}
    for g in got:
        assert abs(g.target - want[g.source]) < 1e-6 * max(1, want[g.source]) and g.source_size == sizes[g.source] and 0 <= g.taken <= 3 * g.size
        taken[g.source] = taken.get(g.source, 0) + g.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 30 for s in want)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, M.mixed(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()), key=repr)


def test_mixing_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 20)
    rows = [(i, "a b c", "s") for i in range(300)] + [(1000 + i, "a b", "t") for i in range(100)]
    got = M.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("s", "t"):
        assert abs(sum(g.taken for g in got if g.source == s) - next(g.target for g in got if g.source == s)) <= 3


def test_mixing_odd_rows(spark):
    got = M.mixed(odd(spark)).collect()
    assert len(got) == len(ODD) and {g.source for g in got} == {"s"}
    mixed = M.mix(odd(spark))
    assert mixed.columns == odd(spark).columns and mixed.count() == sum(g.copies for g in got)
    assert not M.mixed(odd(spark).limit(0)).count() and not M.mix(odd(spark).limit(0)).count()
