"""A corpus pipeline of five stages over `documents`: toxic documents go, one document of each group of near copies stays,
contaminated documents go, sources are mixed to their target weights, and what is left is sharded.

Each stage gets all that its predecessor kept, as a written table, and returns it with the columns of documents (the last
one adds the shard columns).

Cases: rows of null, empty or blank text pass every filter (they have no words, no shingles and no hits) and are mixed and
sharded like others; of rows equal in text one stays, that of the least id, null ids last; ties are broken by id and then by
hashes, so reruns agree; further columns are kept whatever their names, but for those that sharding adds, which are replaced;
a table without rows stays without.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specgrid.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from specgrid.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies: sets of five-word shingles with a similarity of 0.8 or more, linked directly or through others."""
    return ngram_join.without_near_copies(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: No SQL: toxicity scores and pivotal rounding are beyond it; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
