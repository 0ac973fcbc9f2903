"""The corpus pipeline: STAGES run one after the other, each on all rows the one before it kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of documents.  Null and empty texts, very
long texts, repeated rows and further columns go through as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbrascan.llm import near_duplicates, packing, substrings, toxicity
from umbrascan.llm.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels, doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__score", predicted="__toxic").filter("__toxic = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies, by five-word shingles at 0.8; null ids stay."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates.near_duplicates(rows, row="__row").filter(~F.col("kept")).select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that a smaller doc_id holds; texts that lose nothing stay as they are."""
    done = substrings.remove_repeats(docs, out=("__words", "__removed", "__kept"))
    text = F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    size = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.withColumns(size | {"text": text}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]
#: a trained model decides, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
