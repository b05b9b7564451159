"""The queries op1 to op10 and pipeline, with the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tickloom.llm import oracles, quality, toxicity, url_filter
from tickloom.llm.bpe import bpe
from tickloom.llm.embedding_dedup import embedding_components
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.jaccard_join import jaccard_components
from tickloom.llm.labelled import held_out
from tickloom.llm.mixing import mixed
from tickloom.llm.pii import surrogates
from tickloom.llm.substring_dedup import substring_dedup


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scored = quality.quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.BORDER).cast("int").alias("predicted"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark, sf_dir):
    return surrogates(_table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    coded = bpe(_table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_url_filter(spark, sf_dir):
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark, sf_dir):
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixed(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_pii_surrogates, op4_bpe, op5_jaccard_join, op6_url_filter, op7_toxicity, op8_embedding_dedup, op9_substring_dedup, op10_mixing, pipeline)}

ORACLES = {"op2_exact_dedup": oracles.OP2, "op6_url_filter": url_filter.oracle(), "op8_embedding_dedup": oracles.OP8, "op10_mixing": oracles.OP10}
