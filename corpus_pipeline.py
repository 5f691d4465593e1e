"""The corpus pipeline: quality classifier, quality rules, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame,
which is written as Parquet and read again for the next one. All but the last return the columns of
``documents``.

Defined cases, of every stage: an empty table gives an empty one; columns beside those of ``documents`` are passed on by all stages but the
last; rows with equal values are judged alike. What a stage does with null or empty texts and null ids is told by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm.bpe import encode_round_trip
from evidentia.llm.jaccard_join import Rule, keep_one
from evidentia.llm.mixing import mix
from evidentia.llm.quality_net import fit_network, keep_good
from evidentia.llm.quality_rules import keep_sound
from evidentia.llm.session import shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labelled rows that are not held out, does not reject. A null or empty
    text is judged as one to which no filter answers; a null id takes no part in the fit. Without labelled rows every document stays."""
    return keep_good(docs, fit_network(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep. A null or empty text has fewer words than the base rules ask for and goes;
    a null language or source is a group of its own."""
    return keep_sound(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: sets of five-word shingles at 0.8 or more.
    Null and empty texts are alike with nothing and stay, and so do rows with a null id; of rows that repeat an id one stays."""
    return keep_one(docs, Rule(80, 5))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its mixing rate says. A null or empty text has the prior as posterior, and its rate; a null id is rounded like any other."""
    return mix(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each row that the mixture holds. A null text counts as an empty one, which has no tokens."""
    import public_tokenizers

    return encode_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: The stages are a trained network, iterations over the corpus and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
