"""Publication of partition folders: journal, two renames, and recovery after a crash at any point."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.errors import BarError
from barloom.functions.digest import group_digests, merged_digest
from barloom.operators import scope
from barloom.schema import BAR_COLUMNS, DAYS_SCHEMA, PARTITION_COLUMNS, STORED_SCHEMA
from barloom.sources.listing import check_readable, stat_signature
from barloom.files import sync_path, write_json
from barloom.sources.records import file_hashes
from barloom.state import State, safe_path
from barloom.sources.local import hinted, local_frame


def data_files(folder: Path) -> list[Path]:
    return sorted(p for p in folder.glob("*.parquet") if not p.name.startswith((".", "_")))


def folder_signature(folder: Path) -> list:
    """Name, size and times of each data file; a missing or empty folder is an error."""
    files = data_files(folder)
    if not files:
        raise BarError("output-missing")
    return [[p.name, *list(stat_signature(p).values())[1:]] for p in files]


def folder_hashes(spark: SparkSession, folders: dict[str, Path]) -> dict[str, str]:
    """Content hash of each folder: of the sorted hashes of its files, which executors read."""
    there = {k: p for k, p in folders.items() if p.is_dir() and data_files(p)}
    if not there:
        return {}
    files = spark.read.format("binaryFile").load([f"file://{f}" for p in there.values() for f in data_files(p)])
    rows = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha")).collect()
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(os.path.dirname(r["path"]), []).append(r["sha"])
    return {k: hashlib.sha256("".join(sorted(by.get(str(p.resolve()), by.get(str(p), [])))).encode()).hexdigest() for k, p in there.items()}


def read_partitions(spark: SparkSession, root: Path, partitions: list[str]) -> DataFrame:
    """Bars of partition folders with their partition columns; their schema and nulls are checked by misfits."""
    if not partitions:
        return local_frame(spark, [], STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).option("basePath", f"file://{root}/data").parquet(*[f"file://{root}/{p}" for p in partitions])


_STORED = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in STORED_SCHEMA if f.name in BAR_COLUMNS)
_ARROW_NAMES = {"string": "string", "int64": "bigint", "double": "double"}


def _columns_of(path: str) -> str:
    """The columns of a data file in their order, as its footer tells, and those of them that hold nulls."""
    try:
        file = pq.ParquetFile(path)
    except (OSError, pa.ArrowInvalid) as exc:
        return f"unreadable: {exc}"
    names = [f.name for f in file.schema_arrow]
    nulls = set()
    for g in range(file.metadata.num_row_groups):
        for k, name in enumerate(names):
            told = file.metadata.row_group(g).column(k).statistics
            # Where a writer left the number out it is counted.
            if (told.null_count if told is not None and told.has_null_count else file.read_row_group(g, [name]).column(0).null_count):
                nulls.add(name)
    found = ",".join(f"{f.name} {_ARROW_NAMES.get(str(f.type), f.type)}" for f in file.schema_arrow)
    return found + "".join(f"; null {name}" for name in sorted(nulls))


def _footers(batches):
    """partition, columns of each data file."""
    for batch in batches:
        found = [_columns_of(path) for path in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("partition"), pa.array(found, pa.string())], names=["partition", "columns"])


def misfits(spark: SparkSession, root: Path, partitions: list[str]) -> list[str]:
    """Partitions with a data file that has not exactly the bar columns in their order, or a null in one; executors read the footers."""
    files = [(p, str(f)) for p in partitions for f in data_files(safe_path(root, p))]
    if not files:
        return []
    listed = local_frame(spark, files, "partition string, path string").repartition(F.col("path"))
    wrong = listed.mapInArrow(_footers, "partition string, columns string").where(F.col("columns") != _STORED)
    return [r["partition"] for r in wrong.select("partition").distinct().collect()]


def write_partitions(bars: DataFrame, folder: Path) -> None:
    """One sorted file a partition folder, with plain Snappy pages."""
    spark, key = bars.sparkSession, "spark.sql.optimizer.plannedWrite.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        dealt = bars.repartition(*PARTITION_COLUMNS).sortWithinPartitions(*PARTITION_COLUMNS, "code", "timestamp")
        writer = dealt.write.partitionBy(*PARTITION_COLUMNS).option("compression", "snappy")
        writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_1_0").parquet(f"file://{folder}")
    finally:
        spark.conf.set(key, before)
    # Publications carry hashes of their own; a checksum file beside a part would only break reads of a changed part.
    for leftover in Path(folder).rglob(".*.crc"):
        leftover.unlink()


def check_sources(root: Path, sources: list[dict], spark: SparkSession | None = None) -> None:
    """Every source is still the file that was read; with a session its content is hashed again as well."""
    for s in sources:
        path = root / s["source"]
        if check_readable(path, root) != s["signature"]:
            raise BarError(f"source-changed-before-publish: {s['source']}")
    if spark is not None:
        found = file_hashes(spark, [(str(root / s["source"]), s["signature"]) for s in sources])
        for s in sources:
            if found[str(root / s["source"])] != s["sha256"]:
                raise BarError(f"source-content-changed: {s['source']}")


class SourceWatch:
    """Looks at sources again before publications, each at most once in max_age seconds.

    A day's partition has all sources of a market, so without this each source would be looked at twice a partition.
    What changes between two looks is found by the check at the end of the run, which grants completion.
    """

    def __init__(self, root: Path, max_age: float = 1.0):
        self.root, self.max_age, self.looked = root, max_age, {}

    def check(self, sources: list[dict]) -> None:
        for s in sources:
            if time.monotonic() - self.looked.get(s["source"], float("-inf")) > self.max_age:
                check_sources(self.root, [s])
                self.looked[s["source"]] = time.monotonic()


def _journal_path(root: Path, partition: str) -> Path:
    return safe_path(root, f".journal/{hashlib.sha256(partition.encode()).hexdigest()}.json")


def publish(root: Path, watch: SourceWatch, run: str, partition: str, staged: Path, hashes: tuple[str | None, str], digest: str, sources: list[dict]) -> dict:
    """Swap a staged folder in. The journal stays until the state is committed."""
    target = safe_path(root, partition)
    backup = safe_path(root, f".staging/{run}/backup/{hashlib.sha256(partition.encode()).hexdigest()}")
    backup.parent.mkdir(parents=True, exist_ok=True)
    target.parent.mkdir(parents=True, exist_ok=True)
    watch.check(sources)
    journal = {
        "version": 1, "run": run, "source_root": str(watch.root.resolve()), "partition": partition, "staged": str(staged.relative_to(root)),
        "backup": str(backup.relative_to(root)), "old_sha256": hashes[0], "sha256": hashes[1], "digest": digest, "sources": sources,
    }
    for part in (*data_files(staged), staged):
        sync_path(part)
    write_json(_journal_path(root, partition), journal)
    watch.check(sources)
    if target.exists():
        os.replace(target, backup)
    os.replace(staged, target)
    sync_path(target.parent)
    # As it was swapped in: what is done to it from here on is found at the end of the run.
    return {**journal, "signature": folder_signature(target)}


def forget(root: Path, journal: dict) -> None:
    """The state holds the publication now."""
    _journal_path(root, journal["partition"]).unlink()
    shutil.rmtree(safe_path(root, journal["backup"]), ignore_errors=True)


def commit_published(state: State, journals: list[dict]) -> None:
    """Pending days of published partitions replace cached ones, in one new version of the state."""
    if not journals:
        return
    root, by_run = state.root, {}
    for j in journals:
        by_run.setdefault(j["run"], []).append(j["partition"])
        state.meta["partitions"][j["partition"]] = {"sha256": j["sha256"], "digest": j["digest"], "signature": j.get("signature") or folder_signature(safe_path(root, j["partition"]))}
    fresh = None
    for run, partitions in by_run.items():
        pending = state.spark.read.schema(DAYS_SCHEMA).parquet(f"file://{safe_path(root, f'.staging/{run}/pending')}")
        published = hinted(local_frame(state.spark, [(p,) for p in partitions], "partition string"), len(partitions))
        pending = pending.join(published, "partition", "left_semi")
        fresh = pending if fresh is None else fresh.unionByName(pending)
    state.commit(days=fresh)


def content_digests(spark: SparkSession, root: Path, partitions: list[str]) -> dict[str, str]:
    """Digest of what each stored partition holds now, made from its days as at publication; one job for all."""
    place = scope.partition_of(F.col("kind"), F.col("period"), F.col("trade_date"), F.col("market"))
    bars = read_partitions(spark, root, partitions).withColumn("partition", place).select("partition", *BAR_COLUMNS)
    days = group_digests(bars, "partition", "code", "trade_date").withColumnRenamed("trade_date", "day")
    return {r["partition"]: r["digest"] for r in merged_digest(days, "partition").collect()} if partitions else {}


class _Found(NamedTuple):
    """What a journal's target is, as against the journal: its new content, its old one, nothing or another."""

    target: str
    committed: bool
    backup: bool


def _found(j: dict, target: str | None, backup: str | None, known: dict | None) -> _Found:
    state = "new" if target == j["sha256"] else "old" if target is not None and target == j["old_sha256"] else "none" if target is None else "other"
    committed = known is not None and all(known[k] == j[k] for k in ("sha256", "digest"))
    return _Found(state, committed, j["old_sha256"] is not None and backup == j["old_sha256"])


def _step(found: _Found, had_old: bool, unsound: Exception | None) -> str:
    """What is done about a journal; unsound tells why a new content may not stand."""
    steps = {
        ("new", False, True): "commit", ("new", True, True): "keep", ("new", True, False): "keep and warn",
        ("new", False, False): ("restore" if found.backup else "stop: recovery-backup-missing-or-tampered") if had_old else "quarantine",
        "old": "nothing", "none": ("put back" if found.backup else "stop: recovery-output-tampered") if had_old else "nothing", "other": "stop: recovery-output-tampered",
    }
    return steps[found.target] if found.target in steps else steps[found.target, found.committed, unsound is None]


def recover(state: State, source_root: Path, report: dict, log) -> None:
    """Decide every journal that a crash left: forward, back, or into quarantine."""
    root, spark = state.root, state.spark
    journals = [json.loads(p.read_text(encoding="utf-8")) for p in sorted(safe_path(root, ".journal").glob("*.json"))]
    if any(j.get("version") != 1 or j.get("source_root") != str(source_root.resolve()) for j in journals):
        raise BarError("invalid-recovery-journal")
    targets = {j["partition"]: safe_path(root, j["partition"]) for j in journals}
    hashes = folder_hashes(spark, targets)
    backups = folder_hashes(spark, {j["partition"]: safe_path(root, j["backup"]) for j in journals})
    found = {p: _found(j, hashes.get(p), backups.get(p), state.meta["partitions"].get(p)) for j in journals for p in (j["partition"],)}
    replaced = [p for p, f in found.items() if f.target == "new"]
    if misfits(spark, root, replaced):
        raise BarError("output-schema-mismatch")
    digests, forward = content_digests(spark, root, replaced), []
    for j in journals:
        p, unsound = j["partition"], None
        if found[p].target == "new":
            if digests.get(p) != j["digest"]:
                raise BarError("recovery-readback-mismatch")
            try:
                check_sources(source_root, j["sources"], spark)
                report["counts"]["recovery_revalidated_files"] += len(j["sources"])
            except (BarError, OSError) as exc:
                unsound = exc
        step = _step(found[p], j["old_sha256"] is not None, unsound)
        if step.startswith("stop: "):
            raise BarError(step.removeprefix("stop: ")) from unsound
        if step in ("commit", "keep", "keep and warn"):
            report["counts"]["recovered_partitions"] += 1
        if step == "commit":
            forward.append(j)
        elif step == "keep and warn":
            log.issue(f"source-changed-since-committed-publication: {unsound}", p, "warning")
        elif step in ("restore", "quarantine"):
            os.replace(targets[p], safe_path(root, f".staging/rejected-{j['run']}-{hashlib.sha256(p.encode()).hexdigest()[:16]}"))
            log.issue(f"recovery-rejected: {unsound}", p)
        if step in ("restore", "put back"):
            os.replace(safe_path(root, j["backup"]), targets[p])
            if p in state.meta["partitions"]:
                state.meta["partitions"][p]["signature"] = folder_signature(targets[p])
    commit_published(state, forward)
    for j in journals:
        forget(root, j)
    # The lock is held and no journal is left: what other runs staged is abandoned.
    for folder in safe_path(root, ".staging").iterdir():
        if folder.is_dir() and not folder.name.startswith("rejected-"):
            shutil.rmtree(folder, ignore_errors=True)
