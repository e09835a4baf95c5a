"""The source tree as a stream of listings, each micro-batch published by the ingestion engine.

A file source would not see a file again that is modified in place, which is the usual case here. So an offset is
the version of a listing: the tree is listed at each trigger, and a listing that differs from the last version
becomes the next one, written whole before its offset is known. The rows of a batch are what changed between
two versions. The engine's own state makes a batch that is run again after a crash do nothing twice.
"""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from barloom.config import Request
from barloom.files import write_json
from barloom.plans.engine import run
from barloom.sources.listing import list_files

SCHEMA = "version long, change string, path string, size long"
#: Changes of one partition of a batch.
ROWS = 10_000


class Changes(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class ListingVersions:
    """Listings by version, one file each; a version is written once and never changed."""

    def __init__(self, folder: Path):
        self.folder = folder

    def _path(self, version: int) -> Path:
        return self.folder / f"{version}.json"

    def newest(self) -> int:
        return max((int(p.stem) for p in self.folder.glob("*.json")), default=0)

    def read(self, version: int) -> dict[str, dict]:
        """path -> signature; version 0 is the empty listing."""
        return json.loads(self._path(version).read_text(encoding="utf-8")) if version else {}

    def take(self, listing: dict[str, dict]) -> int:
        """The version of a listing: the newest one if nothing changed since, else the next."""
        version = self.newest()
        if listing == self.read(version):
            return version
        self.folder.mkdir(parents=True, exist_ok=True)
        write_json(self._path(version + 1), listing)
        return version + 1

    def forget_before(self, version: int) -> None:
        for path in self.folder.glob("*.json"):
            if int(path.stem) < version:
                path.unlink(missing_ok=True)


def changes_between(old: dict[str, dict], new: dict[str, dict]) -> list[tuple[str, str, int]]:
    """(change, path, size), by path: new, changed and gone files."""
    out = []
    for path in sorted(old.keys() | new.keys()):
        if old.get(path) != new.get(path):
            change = "new" if path not in old else "gone" if path not in new else "changed"
            out.append((change, path, (new.get(path) or old[path])["size"]))
    return out


class BarListing(DataSource):
    """`spark.readStream.format("bar_listing")`; options: source, output, periods (comma-joined), versions (a folder that outlives the query)."""

    @classmethod
    def name(cls) -> str:
        return "bar_listing"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return _ListingReader(self.options)


class _ListingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.request = Request(Path(options["source"]), Path(options["output"]), periods=tuple(options["periods"].split(",")))
        self.versions = ListingVersions(Path(options["versions"]))

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        rows, _ = list_files(self.request)
        return {"version": self.versions.take({path: signature for path, *_, signature in rows if signature})}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        found = changes_between(self.versions.read(start["version"]), self.versions.read(end["version"]))
        rows = [(end["version"], *change) for change in found]
        return [Changes(rows[k : k + ROWS]) for k in range(0, len(rows), ROWS)] or [Changes([])]

    def read(self, partition: Changes):
        yield from partition.rows

    def commit(self, end: dict) -> None:
        self.versions.forget_before(end["version"])


def follow(spark: SparkSession, request: Request, checkpoint: Path, told=None, once: bool = False, seconds: float = 10.0) -> StreamingQuery:
    """Publish the tree as it changes: the same incremental run for every batch with changes.

    told is called with each run's report. A partial or failed run is told of and left to the next change or
    restart, as a bad file stays bad until it is replaced; the state then still has it as not complete.
    """
    request = replace(request, source=request.source.resolve(strict=True), mode="incremental")
    spark.dataSource.register(BarListing)
    stream = spark.readStream.format("bar_listing").options(
        source=str(request.source), output=str(request.output), periods=",".join(request.periods), versions=str(checkpoint / "listings")
    ).load()

    def publish(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        report = run(spark, request)
        if told:
            told(report)

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", str(checkpoint / "query"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
