"""One query per operator over the given tables, whole, with production parameters.

`QUERIES` maps a name to a function of session and folder, `ORACLES` a name to
DuckDB SQL for the same rows.  Operators without SQL are compared with brute force
in `tests/llm`.
"""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession

from taskscope.llm import bpe, decontaminate, jaccard, licences, pii, quality, ranking, resample, sharding, tokens, topk, \
    toxicity, warc
from taskscope.session import fresh_path

#: Folder of the public vocabulary files, unless given otherwise.
TOKENIZERS = "TASKSCOPE_TOKENIZERS"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: in the folder that is set, or in the installed package."""
    folder = os.environ.get(TOKENIZERS)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Base measures and the verdict of the cascade for every document."""
    return quality.cascade(table(spark, sf, "documents"))


def op2_histogram_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in 40 shards of equal bytes."""
    return sharding.shard(table(spark, sf, "documents"), 40)


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every document by a grammar whose insults the labels teach."""
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: spans of the patterns, and what the field adds."""
    docs = table(spark, sf, "documents")
    return pii.find(docs, pii.fit(docs))


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and benchmark items whose passages match, with the place of the match."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every line of every document; a token belongs to the line of its first character."""
    return tokens.section_tokens(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.tiktoken"), rule="first")


def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a similarity of 0.85 or more."""
    return jaccard.jaccard_components(table(spark, sf, "documents"), size=4, percent=85)


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as archives and read back: what each record holds or refers to."""
    path = fresh_path(spark, "warc")
    warc.write(table(spark, sf, "pages"), path)
    found = warc.pages(warc.whole(warc.read(spark, path)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licences.scan(table(spark, sf, "documents"))


def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    return bpe.round_trip(table(spark, sf, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranking.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


def op12_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 vectors with the highest integer inner products of every twentieth vector."""
    return topk.search(table(spark, sf, "embeddings"), k=20, every=20)


def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the quarter that is drawn."""
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), percent=25, least_words=20, seed=7)


QUERIES = {f.__name__: f for f in (
    op1_quality_cascade, op2_histogram_sort, op3_toxicity, op4_pii, op5_decontamination, op6_token_counts,
    op7_jaccard_join, op8_warc, op9_licence_scan, op10_byte_bpe, op11_ranked_search,
    op12_exact_top_k, op13_importance_resampling)}
ORACLES: dict[str, str] = {
    "op1_quality_cascade": quality.ORACLE, "op11_ranked_search": ranking.ORACLE,
    "op12_exact_top_k": topk.ORACLE, "op13_importance_resampling": resample.ORACLE}
