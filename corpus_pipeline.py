"""The corpus pipeline: toxic documents go, one of each group of similar documents
stays, contaminated documents go, personal data is sanitised, and what is left is
encoded. Part of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. Empty tables, nulls and repeated rows have the
results that the operators define for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import drop_shared, read_table, write_shared
from barloom.llm.decontaminate import decontaminate
from barloom.llm.neardup import keep_one
from barloom.llm.pieces import encode_texts
from barloom.llm.pii import sanitise
from barloom.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", sanitise_personal_data),
    ("sentencepiece", encode),
]

#: The fitted classifier and the sanitised texts are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what passes between them is written to the shared folder, and goes when the next table is whole."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_shared(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
