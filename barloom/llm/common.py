"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, as in tests, one is chosen here."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Rows of an Arrow batch that a worker is sent; texts are whole, so the default of 10,000 rows takes much memory on both sides.
BATCH_ROWS = 1000


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _bounded_run(spark: SparkSession):
    """What is planned inside drops its shuffle files when it has run, and sends texts in small batches."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)})


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder; the shuffle files behind it go once it is written, as nothing is computed from them again."""
    shared_folder(df.sparkSession)
    with _bounded_run(df.sparkSession):
        return df.select("*").checkpoint()


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table into the shared folder; the table read back, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _bounded_run(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Keys that a join can treat as hot, at most.
HOT_KEYS = 4096


def join_by_weight(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose column n is the key's number of rows, of total in all.

    Keys with more than a HOT_KEYS-th of all rows are fewer than HOT_KEYS, so their side is broadcast and their
    rows stay where they are; the rest is joined by shuffle, in which no key weighs more than that share.
    """
    hot = F.col(n) * HOT_KEYS > total
    crowded = F.broadcast(per_key.where(hot))
    rest = rows.join(crowded.select(*keys), keys, "left_anti").join(per_key.where(~hot), keys)
    return rows.join(crowded, keys).unionByName(rest)


def held_out(doc_id) -> "F.Column":
    """Rows that no label may be learnt from: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
