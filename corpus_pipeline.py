"""From raw documents to token ids, in five stages.

Each stage works on all rows that the one before kept and its decisions take
effect; what a stage returns is written as Parquet in the shared folder and
read again as the next one's documents.

Defined results, for every stage: an empty table gives an empty one; very long
texts are read whole; other columns, whatever their names, are kept up to the
last stage, which returns its own; a null id is no fault in itself.  What each
says of null and empty texts, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, decontaminate, language_id, near_dedup, quality_rules
from loomwork.llm._shared import documents, materialise, vocabulary_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep.

    A null or empty text fails the base rule and goes; a null language or
    source is a group of its own; rows at a fence (ties) stay; repeated rows are
    judged alike, each counted.
    """
    return quality_rules.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network learnt from the labelled ones.

    A text that is null or has no letter is in no language and goes, as does one
    below the network's least score (one at it, a tie, stays), and everything
    where no row has a language to learn from; of equally likely
    languages (ties) the first by name is taken; repeated rows are judged alike.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8).

    Rows without words (null and empty texts) are linked with nothing and all
    stay; of a group the least known id stays; of rows that repeat id and text
    (ties) one stays.
    """
    return near_dedup.keep_one(docs, size=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    A null or empty text holds none and stays; a run with just enough matches
    (a tie with the limit) counts; repeated rows go or stay together; without
    items all stay.
    """
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and the digests of the ids and of what they decode to.

    A null or empty text has no ids; of equal ranks (ties) the leftmost merges;
    repeated rows are encoded alike.
    """
    coded = bpe.encode_decode(docs, vocabulary_path(bpe.VOCABULARY))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", good_quality),
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Sketch thresholds aside, SQL expresses neither the network nor the encoder.
ORACLE_SQL = None
