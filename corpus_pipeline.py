"""The corpus pipeline: toxicity filter, near-duplicate removal, substring removal, packing.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next stage's docs, so that a stage
first deletes the tables that the operator of the stage before it has left in the shared folder.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import neardup, packing, substring, toxicity
from gaugeflow.llm.shared import made, release, remove_stored, stored, tables

#: Similarity from which the pipeline takes documents as near-duplicates.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is fitted on the labelled documents among them."""
    model = toxicity.train(docs, tables(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, model, "_toxicity").where(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (of the smallest doc_id; null ids come last) of each class of near-duplicates, which are alike by NEAR_PERCENT or more."""
    return neardup.one_of_each(docs, NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 50-word passages that a smaller doc_id has too."""
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


#: What the last stage of a run left in the shared folder, by the run's thread.
_left: dict[int, list[str]] = {}


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame], first: bool) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:  # what the last stage of an earlier run left may still be read
            remove_stored(spark, _left.pop(threading.get_ident(), []))
        before = set(made())
        out = stage(spark, docs, sf_dir)
        _left[threading.get_ident()] = [p for p in made() if p not in before]
        return out

    return run


STAGES = [(name, _tidy(stage, name == "toxicity")) for name, stage in (("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("substrings", cut_repeats), ("packing", pack))]

#: Model scores and subword ids are beyond SQL: tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = tables(spark, sf_dir, "documents")
    read = None
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs = stored(docs, "stage")
            if read is not None:  # what the stage before has read
                release(read)
            read = docs
        docs = stage(spark, docs, sf_dir)
    return docs
