"""A training-data pipeline over ``documents``: filter, deduplicate, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each
stage's rows to the shared folder and reads them back for the next.

Defined cases, for every stage: null texts count as empty; an empty table gives no
rows; other columns, whatever their names, pass unchanged (but for the last stage,
which returns pieces); rows that repeat an id and its text are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from orrery.storage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.3 or more; learned from labelled documents of the stage's input (a bounded sample).

    Empty texts score 0 and stay; without labels of both kinds all stay; an id's
    labels hold for every row that has it; a null id has no label.
    """
    model = toxicity.fit(toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, A-Z lower-cased: that with the largest id.

    Empty texts equal each other; a null id stays only where no other id has the
    text; rows that repeat both id and text stay together.
    """
    return exact_dedup.dedup_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that with the smallest id.

    Texts without words link with nothing and stay; shorter texts are one shingle;
    rows that repeat an id are one document; rows with a null id stay unless equal
    sets have an id.
    """
    return ngram_join.drop_near_copies(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none or up to three times.

    The null source is a source; documents without words have no size and are taken
    as often as their source's whole epochs say; rows that repeat id and text of a
    source are taken equally often.
    """
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 ids, with the ids.

    Every row is packed, repeated ones as well; an empty text is its end id alone; a
    null id stays null.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack_windows)]
#: A trained network and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
