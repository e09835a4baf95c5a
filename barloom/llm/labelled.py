"""Rows to learn from: labelled texts outside the held-out fifth, one of each family of copies."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import shingles
from barloom.llm.common import cut_lineage, held_out

#: Labels are broadcast up to this many (16 bytes each); beyond it texts are joined to them by shuffle.
BROADCAST_LABELS = 2_000_000


def _bounded(labels: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(labels) if labels.count() <= limit else labels


#: Min-hashes that make a family: copies and most near copies have all of them in common, unrelated texts do not.
FAMILY_HASHES = 3


def _families(batches):
    """A hash of the least shingle hashes under FAMILY_HASHES orders; of a text without words, of the text."""
    for batch in shingles.small_batches(batches):
        hashes, bounds = shingles.shingle_hashes(batch.column("text"))
        family = np.zeros(batch.num_rows, np.uint64)
        some = np.flatnonzero(np.diff(bounds))
        with np.errstate(over="ignore"):
            for k in range(FAMILY_HASHES if len(some) else 0):
                order = shingles.mix(hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
                family[some] = shingles.mix(family[some] * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(order, bounds[:-1][some]))
        for i in np.flatnonzero(np.diff(bounds) == 0).tolist():
            text = (batch.column("text")[i].as_py() or "").encode("utf-8")
            family[i] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), pa.array(family.view(np.int64))], names=["doc_id", "target", "family"])


def training_labels(docs: DataFrame, labels: DataFrame, target: str, broadcast_limit: int = BROADCAST_LABELS) -> DataFrame:
    """doc_id, target (0 or 1) of one row per family and label; none of the held-out rows, of null labels or of ids labelled both ways."""
    open_labels = labels.where(~held_out(F.col("doc_id")) & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    agreed = open_labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("int").alias("target"), F.max(target).cast("int").alias("most"))
    agreed = cut_lineage(agreed.where("target = most").select("doc_id", "target"))
    rows = labelled_texts(docs, agreed, broadcast_limit)
    families = rows.mapInArrow(_families, "doc_id long, target int, family long")
    return cut_lineage(families.groupBy("family", "target").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "target"))


def labelled_texts(docs: DataFrame, chosen: DataFrame, broadcast_limit: int = BROADCAST_LABELS) -> DataFrame:
    """doc_id, text, target of the chosen ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id")))
    return texts.join(_bounded(chosen, broadcast_limit), "doc_id")


def bounded_sample(chosen: DataFrame, rows: int) -> DataFrame:
    """About `rows` of the chosen ids at most, by a hash of the id; all of them if there are fewer."""
    share = rows / max(1, chosen.count())
    if share >= 1:
        return chosen
    return chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
