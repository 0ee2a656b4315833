"""From raw documents to packed training sequences, in five stages.

Stages read whole tables; columns besides those they name are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import jaccard, mixing, packing, pseudonyms, toxicity
from veriloom.llm.shared import free_name, materialize

REJECT = 0.5  # documents scored as toxic with at least this probability go
KEY = b"veriloom example key"  # a deployment passes a key of its own


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under REJECT by trees fitted on the labelled ones (crc32(doc_id) mod 4 = 2 teaches nothing).

    Null and empty texts are scored as texts without words, and so kept; long texts are scored whole; repeated rows each
    get the same score; a null doc_id has no label; without labels a base rate is scored, which keeps all; an empty
    table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.fold("doc_id") % 4 != 2)
    model = toxicity.fit(docs, labels)
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < REJECT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more.

    The one with the least doc_id stays.  Rows without an id, or with an id that other texts have too, stand for
    themselves; of rows equal in id and text one stays; texts without words (null, empty) are linked with nothing and
    stay; long texts are shingled whole; an empty table gives no rows.
    """
    return jaccard.keep_one(docs, width=5, percent=80)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with keyed pseudonyms for personal values.

    Every row stays, repeated ones alike; null texts stay null, empty ones empty; long texts are searched whole; an empty
    table gives no rows.
    """
    return pseudonyms.pseudonymize(docs, key=KEY, found_col=None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' repetitions in the mix of sources.

    A null source is one of its own, after all others; texts without words (null, empty) are taken nowhere; repeated rows
    are documents each; ties in the seeded order go by doc_id, then size; the last repetition of a source is cut to
    the words still wanted; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of several permitted lengths.

    Long texts are cut into pieces of the largest length and a rest; null and empty texts are one piece of size 0 in no
    sequence; repeated rows are packed each; equal sizes go by doc_id, then piece; an empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", hide_personal_data), ("mixing", mix), ("packing", pack)]

#: Trees, components, keyed permutations and best-fit can't be said in SQL; tests/llm/test_pipeline.py holds each stage
#: against a version of its own in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
