"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of their input,
whatever further columns it has:

1. language_id drops texts whose language the network can't tell: null, without letters, or where no
   language is likelier than all others together.
2. ngram_join keeps one row, the one with the smallest id, of each group of near duplicates, whatever
   ids repeat or are missing: five-word shingles, Jaccard similarity 0.8 or more, joined by links.
3. decontamination drops documents that contain 0.8 or more of a benchmark item's five-word shingles.
4. secret_scan masks every secret in the text and sets n_chars, where there is one, to the new length; all rows stay.
5. packing returns the pieces of the packed sequences.

Defined results: null texts go in stage 1 and pass all other stages (a null text packs as one end id);
null ids are carried along; rows of one id are judged each by itself; equal rows are near duplicates
of each other; empty tables give empty tables; columns of clashing names stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectry.llm.common import read_table, stored
from dialectry.llm.decontamination import without_items
from dialectry.llm.language_id import with_language
from dialectry.llm.ngram_join import one_per_component
from dialectry.llm.packing import pack, with_digest
from dialectry.llm.secret_scan import redacted


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs, per_label=500)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_component(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_items(docs, read_table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redacted(docs, threshold=0.5)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return with_digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0))


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The stages train models and pack token ids, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
