"""The ingestion dataflow: scan, convert and verify.

Sources that changed are read once, into a staging table; everything after, the
verdicts, fingerprints, comparison with the state, merging, read-back and
verification, is DataFrame work over all of them together. The driver holds one
small row a source and a partition, and does what no table can: locks, renames,
journals and reports.
"""

from __future__ import annotations

import json
import shutil
import uuid
from dataclasses import replace
from functools import partial
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import Request
from barloom.errors import BarError, Cancelled
from barloom.functions.clock import market_clock
from barloom.functions.digest import group_digests, merged_digest
from barloom.operators import blocking, changes, decode, evidence, fingerprint, merge, scope
from barloom.publish import (
    SourceWatch, check_sources, commit_published, folder_hashes, folder_signature, forget, misfits, publish, read_partitions, recover, write_partitions,
)
from barloom.report import write_text_report
from barloom.schema import BAR_COLUMNS, DAYS_SCHEMA, PROFILE, RECEIPTS_SCHEMA, RULE_VERSION, VALIDATION_VERSION
from barloom.operators.segments import VERDICTS, join_all, verdict
from barloom.sources.listing import check_readable, scan_sources
from barloom.sources.records import Told, Wanted, cut, file_verdicts, read_files, record_columns
from barloom.files import write_json
from barloom.state import State, output_lock, own_output, safe_path
from barloom.streaming.progress import RunLog
from barloom.sources.local import hinted, local_frame

COUNTERS = (
    "source_files", "new_days", "revised_days", "reused_days", "written_partitions", "stat_reused_files", "scope_reused_files",
    "content_revalidated_files", "checked_partitions", "content_verified_partitions", "recovered_partitions", "recovery_revalidated_files",
)
#: Seconds between looks at a running job.
POLL_SECONDS = 0.1
FAILURES = (BarError, OSError, ValueError, PySparkException, Py4JJavaError)


def unverified() -> dict:
    return {
        "conversion_consistency": {"status": "unverified", "rule_version": RULE_VERSION},
        "coverage": {"status": "unverified", "reason": "No validated membership, calendar and pause evidence.", "scope": None},
        "external_evidence": {"status": "unverified", "scope": []},
        "field_profile": {"status": "unverified", "profile": PROFILE, "untested": ["independent-price-scale", "independent-volume-unit", "unknown-record-words"]},
    }


class Run:
    def __init__(self, spark: SparkSession, request: Request, action: str, report: dict, log: RunLog, cancel):
        self.spark, self.request, self.action, self.report, self.log, self.cancel = spark, request, action, report, log, cancel
        self.counts, self.run_id = report["counts"], report["run_id"]
        self.blocked: set[str] = set()
        self.checked: set[str] = set()
        self.codes: dict[str, set[str]] = {}
        self.blocked_groups: dict[tuple, set[str]] = {}
        self.told: tuple[int, int] | None = None
        #: source -> identity of what this run read or reused.
        self.identity: dict[str, dict] = {}

    def check_cancel(self) -> None:
        if self.cancel is not None and self.cancel():
            raise Cancelled("cancelled")

    def block(self, rows: DataFrame) -> None:
        """Rows of (partition, code)."""
        for r in blocking.blocking_codes(rows, "partition").collect():
            self.blocked.add(r["partition"])
            self.codes.setdefault(r["partition"], set()).update(r["codes"])

    def frame(self, names, schema: str = "source string") -> DataFrame:
        return local_frame(self.spark, [(n,) for n in names], schema)

    # -- check ---------------------------------------------------------------

    def check_phase(self, root: Path, sources: list[dict]) -> bool:
        """False if the action ends here."""
        self.log.phase("check")
        self.root, self.state = root, State(self.spark, root)
        journals = list(safe_path(root, ".journal").glob("*.json"))
        if self.action == "convert":
            recover(self.state, self.request.source, self.report, self.log)
        elif self.action == "verify" and journals:
            raise BarError("pending-recovery-run-convert")
        if self.action == "scan":
            return False
        self.evidence, self.evidence_hash, self.evidence_failed = None, None, False
        if self.request.evidence is not None:
            try:
                self.evidence, self.evidence_hash = evidence.load_evidence(self.request.evidence)
            except BarError as exc:
                self.log.issue(exc)
                self.evidence_failed = True
        self.needed = {(c["code"], c["period"]) for c in (self.evidence or {}).get("comparisons", ())}
        for s in sources:
            s["source"] = str(Path(s["path"]).relative_to(self.request.source))
        self.sources = {s["source"]: s for s in sources}
        self.days = self.state.days
        self._check_known()
        return True

    def _check_known(self) -> None:
        """Sources that are gone, and remembered partitions that this run touches: one job for both."""
        request, partitions = self.request, self.state.meta["partitions"]
        wanted = lambda k: k["period"] in request.periods and (not request.codes or k["code"] in request.codes)
        known = [n for n, k in self.state.meta["sources"].items() if wanted(k)]
        if not known and not partitions:
            return
        condition = F.col("period").isin(*request.periods)
        if request.codes:
            condition = condition & F.col("code").isin(*request.codes)
        if self.action == "convert" and request.mode != "full" and request.bounded:
            condition = condition & scope.partition_overlaps(F.col("day"), F.col("period"), *request.bounds)
        relevant = changes.relevant_partitions(self.frame(partitions, "partition string"), self.days, condition)
        gone = changes.missing_sources(self.frame(known), self.frame(self.sources))
        facts = gone.select(F.lit("gone").alias("fact"), F.col("source").alias("name")).unionByName(relevant.select(F.lit("partition").alias("fact"), F.col("partition").alias("name")))
        found: dict[str, list[str]] = {"gone": [], "partition": []}
        for r in facts.collect():
            found[r["fact"]].append(r["name"])
        for name in sorted(found["gone"]):
            self.log.issue("source-missing", request.source / name)
        if found["gone"]:
            self.block(blocking.blocked_by_source(self.days, self.frame(found["gone"])))
        self._check_outputs(sorted(found["partition"]))

    def _check_outputs(self, names: list[str]) -> None:
        partitions, suspect = self.state.meta["partitions"], {}
        for name in names:
            try:
                path = safe_path(self.root, name)
                if self.action == "verify" or self.request.mode == "full" or folder_signature(path) != partitions[name]["signature"]:
                    suspect[name] = path
                else:
                    self.checked.add(name)
            except (BarError, OSError) as exc:
                self._tampered(name, exc)
        found = folder_hashes(self.spark, suspect)
        for name in suspect:
            if found.get(name) == partitions[name]["sha256"]:
                self.checked.add(name)
            else:
                self._tampered(name, "output-tampered")
        self.counts["checked_partitions"] += len(self.checked)

    def _tampered(self, name: str, why) -> None:
        self.log.issue(f"output-tampered: {why}", self.root / name)
        self.blocked.add(name)

    # -- source --------------------------------------------------------------

    def source_phase(self) -> None:
        self.log.phase("source")
        reused = self._reusable() if self.action == "convert" and not self.evidence_failed else {}
        self.reused: dict[str, tuple] = {}
        self.failed: dict[str, object] = {}
        self.verdicts: dict[str, dict] = {}
        self.warnings: dict[str, list[dict]] = {}
        self.bad_days: dict[str, list[str]] = {}
        self.candidates: dict[str, dict] = {}
        self.pending = local_frame(self.spark, [], DAYS_SCHEMA)
        #: What is to be done for sources that are settled, until they are told of in their order.
        self.settled = {n: partial(self._reuse, n, self.sources[n], how) for n, how in reused.items()}
        self.turn = 0
        changed = [n for n in self.sources if n not in reused]
        self._take_turns()
        if changed:
            self._read_changed(changed)

    def _take_turns(self) -> None:
        """Tell of sources in their order, each with its issues, as far as they are settled."""
        names = list(self.sources)
        while self.turn < len(names) and names[self.turn] in self.settled:
            self.check_cancel()
            name = names[self.turn]
            self.turn += 1
            facts = {"index": self.turn, "total": len(names), "code": self.sources[name]["code"], "period": self.sources[name]["period"]}
            self.log.emit("source", **facts)
            self.settled.pop(name)()
            self.log.emit("source_complete", **facts)

    def _reusable(self) -> dict[str, tuple]:
        """source -> (counter, days, stored warnings) for sources that need no reading."""
        request, meta = self.request, self.state.meta
        if request.mode == "full":
            return {}
        same = {
            n: meta["sources"][n] for n, s in self.sources.items()
            if n in meta["sources"] and meta["sources"][n].get("signature") == s["signature"] and (s["code"], s["period"]) not in self.needed
        }
        if not same:
            return {}
        mine = self.days.join(hinted(self.frame(same), len(same)), "source", "left_semi")
        sound = self.checked - self.blocked
        good = hinted(self.frame(sound, "partition string"), len(sound))
        if not request.bounded:
            if request.mode != "incremental":
                return {}
            bad = {r["source"] for r in mine.join(good, "partition", "left_anti").select("source").distinct().collect()}
            counts = {r["source"]: r["count"] for r in mine.groupBy("source").count().collect()}
            return {n: ("stat_reused_files", counts.get(n, 0), []) for n, k in same.items() if k.get("complete") and n not in bad}
        return self._covered(same, mine, good)

    def _covered(self, same: dict[str, dict], mine: DataFrame, good: DataFrame) -> dict[str, tuple]:
        """Sources whose asked days a receipt of the same content contains, and whose cached days are still those of the receipt."""
        if not self.state.meta["parts"]["receipts"]:
            return {}
        (start, end), now = self.request.bounds, ("signature", "sha256", "rule_version", "validation_version")
        rows = [(n, _canonical(k["signature"]), k["sha256"], RULE_VERSION, VALIDATION_VERSION) for n, k in same.items()]
        current = hinted(local_frame(self.spark, rows, "source string, " + ", ".join(f"{c} string" for c in now)), len(same))
        receipts = self.state.table("receipts").join(current, ["source", *now], "left_semi")
        # One row a source at most.
        cover = {r["source"]: r for r in changes.first_around(receipts, start, end, carry=("warnings",)).collect()}
        if not cover:
            return {}
        schema = "source string, receipt_start string, receipt_end string"
        chosen = hinted(local_frame(self.spark, [(n, r["receipt_start"], r["receipt_end"]) for n, r in cover.items()], schema), len(cover))
        inside = F.col("day").between(start, end)
        columns = ("raw_hash", "digest", "rows", "partition", "rule_version", "good")
        held = self.state.table("receipt_days").where(inside).withColumnsRenamed({"start": "receipt_start", "end": "receipt_end"})
        held = held.join(chosen, ["source", "receipt_start", "receipt_end"], "left_semi").withColumns({"rule_version": F.lit(RULE_VERSION), "good": F.lit(True)})
        cached = mine.where(inside).join(chosen.select("source"), "source", "left_semi")
        cached = cached.join(good.withColumn("_good", F.lit(True)), "partition", "left").withColumn("good", F.coalesce("_good", F.lit(False)))
        valid = changes.corroborated(held, cached, ("day",), columns).select("source", F.lit("valid").alias("fact"), F.col("valid").cast("long").alias("n"))
        facts: dict[str, dict[str, int]] = {n: {} for n in cover}
        for r in valid.unionByName(cached.groupBy("source").agg(F.lit("days").alias("fact"), F.count("*").alias("n"))).collect():
            facts[r["source"]][r["fact"]] = r["n"]
        # A receipt without days in the interval is valid if nothing is cached there either.
        return {n: ("scope_reused_files", facts[n].get("days", 0), json.loads(r["warnings"])) for n, r in cover.items() if facts[n].get("valid", 1)}

    def _reuse(self, name: str, s: dict, how: tuple) -> None:
        counter, days, warnings = how
        known = self.state.meta["sources"][name]
        self.identity[name] = {"source": name, "signature": s["signature"], "sha256": known["sha256"]}
        try:
            check_sources(self.request.source, [self.identity[name]])
        except (BarError, OSError) as exc:
            self.log.issue(exc, s["path"])
            self.block(blocking.blocked_by_source(self.days, self.frame([name])))
            return
        self.counts[counter] += 1
        self.counts["reused_days"] += days
        self.reused[name] = (counter, days)
        self.log.issues(dict(w) for w in warnings)

    def _fail(self, name: str, reason, details: dict | None = None) -> None:
        self.failed[name] = reason
        self.log.issue(reason, self.sources[name]["path"], **(details or {}))

    def _read_changed(self, names: list[str]) -> None:
        """Read, judge and fingerprint all changed sources; leaves pending days and candidates for completion."""
        stage = safe_path(self.root, f".staging/{self.run_id}")
        stage.mkdir(parents=True, exist_ok=True)
        self.shrunk = self._shrunk(names)
        ready = [n for n in names if self._as_listed(n)]
        self._take_turns()
        if ready:
            files, records = self._read(ready, stage)
            sound = [n for n in ready if n in self.verdicts and n not in self.failed]
            self._compare_days(sound, self.warnings, files, records, stage)
        if self.failed:
            self._block_failed()

    def _shrunk(self, names: list[str]) -> set[str]:
        known = [(n, k["signature"]["size"]) for n in names if (k := self.state.meta["sources"].get(n, {})).get("signature")]
        if not known:
            return set()
        sizes = [(n, self.sources[n]["signature"]["size"]) for n in names]
        return {r["source"] for r in changes.shrunk(*(local_frame(self.spark, rows, "source string, size long") for rows in (sizes, known))).collect()}

    def _as_listed(self, name: str) -> bool:
        """Whether the source still is the file that was listed, by a path without links."""
        s = self.sources[name]
        try:
            if check_readable(Path(s["path"]), self.request.source) != s["signature"]:
                raise BarError(f"source-changed: {s['path']}")
            return True
        except (BarError, OSError) as exc:
            self.settled[name] = partial(self._fail, name, exc)
            return False

    def _wanted(self) -> Wanted:
        paths: dict[tuple, list[str]] = {}
        for s in self.sources.values():
            paths.setdefault((s["code"], s["period"]), []).append(s["path"])
        times: dict[str, set[int]] = {}
        for c in (self.evidence or {}).get("comparisons", ()):
            for path in paths.get((c["code"], c["period"]), ()):
                times.setdefault(path, set()).add(c["timestamp"] // 1000)
        start, end = ((d or "").replace("-", "") for d in (self.request.start, self.request.end))
        return Wanted(start, end, {k: frozenset(v) for k, v in times.items()})

    def _read(self, names: list[str], stage: Path) -> tuple[DataFrame, DataFrame]:
        """One pass over the ranges of all files, into staging; a table of files and one of records. Files are judged as their last ranges end."""
        columns = ("code", "market", "period", "kind")
        info = [(self.sources[n]["path"], n, *(self.sources[n][k] for k in columns)) for n in names]
        info = hinted(local_frame(self.spark, info, "path string, source string, code string, market string, period string, kind string"), len(names))
        told = self.spark.sparkContext.accumulator([], Told())
        files = [(self.sources[n]["path"], self.sources[n]["signature"]) for n in names]
        read = read_files(self.spark, files, self._wanted(), told=told).join(info, "path")
        ranges = {f[0]: {r.start: r for r in cut(f[0], f[1]["size"], f[1])} for f in files}
        by_path = {self.sources[n]["path"]: n for n in names}
        seen: dict[str, dict[int, dict]] = {}
        read_so_far = 0

        def listen() -> None:
            nonlocal read_so_far
            fresh, read_so_far = told.value[read_so_far:], len(told.value)
            for segment in fresh:
                own = seen.setdefault(segment["path"], {})
                own[segment["start"]] = segment
                if len(own) == len(ranges[segment["path"]]) and by_path[segment["path"]] not in self.verdicts:
                    self._settle(by_path[segment["path"]], verdict(join_all(own.values())))
            self._take_turns()

        self._in_background(lambda: read.write.parquet(f"file://{stage}/read"), names, listen)
        listen()
        staged = self.spark.read.schema(read.schema).parquet(f"file://{stage}/read")
        file_verdicts(staged).write.parquet(f"file://{stage}/files")
        judged = self.spark.read.schema(VERDICTS).parquet(f"file://{stage}/files").join(info.select("path", "source"), "path")
        for r in judged.select("source", "n", "length", "failure", "sha256", "bad").collect():
            if r["source"] not in self.verdicts:
                self._settle(r["source"], {**r.asDict(recursive=True)})
            if r["source"] in self.identity:
                self.identity[r["source"]]["sha256"] = r["sha256"]
        self._take_turns()
        records = staged.where("rec IS NOT NULL").select("source", *columns, *record_columns()).withColumn("clock", market_clock(F.col("w0")))
        return judged.select("source", "inventory"), records

    def _settle(self, name: str, found: dict) -> None:
        self.verdicts[name] = found
        self.settled[name] = partial(self._judge, name, found)

    def _judge(self, name: str, found: dict) -> None:
        """The source's own issues, from what was found in the whole of it."""
        s, failure = self.sources[name], found["failure"]
        if failure and failure.startswith("source-"):
            self._fail(name, failure)
            return
        self.identity[name] = {"source": name, "signature": s["signature"], "sha256": found.get("sha256")}
        self.counts["content_revalidated_files"] += 1
        if name in self.shrunk:
            self._fail(name, "source-shrunk")
            return
        told = {b["blocking"]: _price_details(s, b) for b in found["bad"]}
        if failure:
            self._fail(name, failure, told.get(True) if failure == "invalid-ohlc" else None)
            if failure == "invalid-ohlc":
                self.bad_days[name] = told[True]["days"]
            return
        self.warnings[name] = [{"category": "warning", "reason": "invalid-ohlc-outside-scope", **told[False], "path": s["path"]}] if False in told else []
        self.log.issues(dict(w) for w in self.warnings[name])

    def _in_background(self, job, names: list[str], listen) -> None:
        """Run a Spark job that can be cancelled; meanwhile listen to its finished tasks and tell of its progress."""
        context, group, failure = self.spark.sparkContext, f"barloom-{uuid.uuid4().hex}", []

        def work():
            try:
                context.setJobGroup(group, "read sources", interruptOnCancel=True)
                job()
            except Exception as exc:  # noqa: BLE001 - handed to the caller's thread
                failure.append(exc)

        thread = InheritableThread(target=work)
        thread.start()
        try:
            while thread.is_alive():
                thread.join(POLL_SECONDS)
                self.check_cancel()
                self._tell_progress(group, names)
                listen()
        except Cancelled:
            context.cancelJobGroup(group)
            thread.join()
            raise
        if failure:
            raise failure[0]

    def _tell_progress(self, group: str, names: list[str]) -> None:
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(group) for k in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())]
        done, total = (sum(getattr(s, k) for s in stages if s) for k in ("numCompletedTasks", "numTasks"))
        if total and (done, total) != self.told:
            self.told = (done, total)
            self.log.emit("reading", sources=len(names), tasks_done=done, tasks=total)

    def _compare_days(self, sound: list[str], warnings: dict, files: DataFrame, records: DataFrame, stage: Path) -> None:
        spark, keys = self.spark, ("source", "day")
        inside = scope.in_days(F.col("day"), *((d and d.replace("-", "")) for d in (self.request.start, self.request.end)))
        mine = hinted(self.frame(sound), len(sound))
        records = records.join(mine, "source", "left_semi")
        prints = fingerprint.fingerprints(records.where(inside))
        prints = prints.withColumn("partition", scope.partition_of(F.col("kind"), F.col("period"), F.col("day"), F.col("market"))).withColumn("rule_version", F.lit(RULE_VERSION))
        days_columns = self.days.columns
        prints = prints.select(*days_columns, "preclose_raw")
        prints.write.parquet(f"file://{stage}/prints")
        prints = spark.read.schema(prints.schema).parquet(f"file://{stage}/prints")
        inventory = files.join(mine, "source", "left_semi").select("source", F.explode("inventory").alias("d")).select("source", "d.day")
        cached = self.days.join(mine, "source", "left_semi")
        fewer = prints.join(cached.select(*keys, F.col("rows").alias("was")), list(keys)).where("rows < was")
        judged = changes.classify_days(prints, cached.where(inside), keys, ("raw_hash", "rule_version")).where("change <> 'removed'")
        counted = changes.completeness(cached, inventory)
        facts = changes.removed_days(cached, inventory, "source").groupBy("source").agg(F.lit("removed-days").alias("fact"), F.count("*").alias("n"))
        facts = facts.unionByName(fewer.groupBy("source").agg(F.lit("removed-records").alias("fact"), F.count("*").alias("n")))
        facts = facts.unionByName(judged.groupBy("source", F.col("change").alias("fact")).agg(F.count("*").alias("n")))
        facts = facts.unionByName(counted.select("source", F.lit("days").alias("fact"), F.col("source_days").alias("n")))
        found: dict[str, dict[str, int]] = {n: {} for n in sound}
        for r in facts.collect():
            found[r["source"]][r["fact"]] = r["n"]
        self._compare_evidence([n for n in sound if "removed-days" not in found[n]], records)
        for name in sound:
            lost = next((k for k in ("removed-days", "removed-records") if k in found[name]), None)
            if lost:
                self._fail(name, lost)
        good = [n for n in sound if n not in self.failed]
        for name in good:
            for change in ("new", "revised", "reused"):
                self.counts[f"{change}_days"] += found[name].get(change, 0)
            self.candidates[name] = {"warnings": warnings[name], "day_count": found[name].get("days", 0)}
        now = prints.join(hinted(self.frame(good), len(good)), "source", "left_semi")
        wanted = judged if self.action == "verify" else judged.where("change <> 'reused'")
        pending = now.join(wanted.select(*keys), list(keys), "left_semi").select(*days_columns)
        pending.write.parquet(f"file://{stage}/pending")
        self.pending = spark.read.schema(self.days.schema).parquet(f"file://{stage}/pending")
        #: Bars of the pending days, from the staged records.
        self.bars = decode.to_bars(records.where(inside).join(self.pending.select(*keys), list(keys), "left_semi"))
        self.manifest = now.select("source", "day", "raw_hash", "digest", "rows", "partition", "preclose_raw")

    def _compare_evidence(self, names: list[str], records: DataFrame) -> None:
        if not self.evidence:
            return
        needed = [n for n in names if (self.sources[n]["code"], self.sources[n]["period"]) in self.needed]
        bars = decode.to_bars(records.join(hinted(self.frame(needed), len(needed)), "source", "left_semi"))
        matches = evidence.match_evidence(evidence.expected_fields(self.spark, self.evidence), bars)
        self.matched = sum(r["matched"] for r in matches.collect())

    def _block_failed(self) -> None:
        rows = [(n, *(self.sources[n][k] for k in ("code", "market", "period", "kind"))) for n in self.failed]
        failed = local_frame(self.spark, rows, "source string, code string, market string, period string, kind string")
        self.block(blocking.blocked_by_source(self.days, failed))
        bad = [(n, d) for n, days in self.bad_days.items() for d in days]
        if bad:
            days = local_frame(self.spark, bad, "source string, day string").join(failed, "source")
            days = days.withColumn("partition", scope.partition_of(F.col("kind"), F.col("period"), F.col("day"), F.col("market")))
            self.block(blocking.blocked_by_day(days))
        for r in blocking.groups_without_history(failed, self.days).collect():
            self.blocked_groups.setdefault((r["period"], r["market"], r["kind"]), set()).add(r["code"])

    # -- publish -------------------------------------------------------------

    def publish_phase(self) -> None:
        external = {"status": "unverified", "scope": []}
        if self.evidence:
            count, matched = len(self.evidence["comparisons"]), getattr(self, "matched", 0)
            external = {
                "status": "matched" if matched == count else "mismatch", "provenance": self.evidence["source"]["provenance"], "source": self.evidence["source"],
                "evidence_sha256": self.evidence_hash, "scope": self.evidence["comparisons"], "matched": matched, "expected": count, "coverage_claim_accepted": False,
            }
            if external["status"] == "mismatch":
                self.evidence_failed = True
                self.log.issue("evidence-mismatch-or-missing-scope")
        self.report["verification"]["external_evidence"] = external
        self.log.phase("publish")
        affected: dict[str, set[str]] = {}
        for r in blocking.affected_sources(self.pending, self.days).collect() if self.candidates else ():
            affected.setdefault(r["partition"], set()).add(r["source"])
        names = sorted(affected)
        ready = {p: ids for p in names if (ids := self._identities(p, affected[p])) is not None}
        staged = self._stage_partitions(list(ready)) if ready else {}
        journals, watch = [], SourceWatch(self.request.source)
        try:
            for index, name in enumerate(names, 1):
                self.check_cancel()
                self.log.emit("partition", index=index, total=len(names), path=name)
                if name not in ready:
                    self.log.issue("partition-unpublishable", name, blocking_codes=sorted(self._causes(name, affected[name])))
                    self.blocked.add(name)
                else:
                    try:
                        outcome = staged[name]
                        if isinstance(outcome, Exception):
                            raise outcome
                        if self.action == "verify":
                            watch.check(ready[name])
                            self.counts["content_verified_partitions"] += 1
                        else:
                            journals.append(publish(self.root, watch, self.run_id, name, *outcome, ready[name]))
                            self.counts["written_partitions"] += 1
                    except FAILURES as exc:
                        self.log.issue(exc, name)
                        self.blocked.add(name)
                self.log.emit("partition_complete", index=index, total=len(names), path=name)
        finally:
            # Also after a cancellation: what was swapped in is complete and checked.
            if journals:
                commit_published(self.state, journals)
                for j in journals:
                    forget(self.root, j)
                self.days = self.state.days

    def _causes(self, partition: str, sources: set[str]) -> set[str]:
        out = set(self.codes.get(partition, ()))
        for name in sources:
            out |= self.blocked_groups.get(self._group(name), set())
        return out

    def _group(self, name: str) -> tuple:
        s = self.sources.get(name) or self.state.meta["sources"].get(name, {})
        return s.get("period"), s.get("market"), s.get("kind")

    def _identities(self, partition: str, sources: set[str]) -> list[dict] | None:
        """The identity of every affected source, or None if the partition cannot be published."""
        if partition in self.blocked or self.evidence_failed:
            return None
        out = []
        for name in sorted(sources):
            known = self.state.meta["sources"].get(name, {})
            own = self.identity.get(name)
            if own is None and known.get("signature") and known.get("sha256"):
                own = {"source": name, "signature": known["signature"], "sha256": known["sha256"]}
            if own is None or self._group(name) in self.blocked_groups:
                return None
            out.append(own)
        return out

    def _stage_partitions(self, names: list[str]) -> dict[str, object]:
        """For every partition: what publish needs, or the failure. One job merges, one writes, one reads back."""
        known, out, old = self.state.meta["partitions"], {}, []
        hashes = folder_hashes(self.spark, {p: safe_path(self.root, p) for p in names})
        for p in names:
            target = safe_path(self.root, p)
            try:
                if target.exists():
                    if p not in known or hashes.get(p) != known[p]["sha256"]:
                        raise BarError("output-tampered-or-untracked")
                    old.append(p)
                elif p in known:
                    raise BarError("output-missing")
            except FAILURES as exc:
                out[p] = exc
        for p in misfits(self.spark, self.root, old):
            out[p] = BarError("output-schema-mismatch")
        old = [p for p in old if p not in out]
        stage = safe_path(self.root, f".staging/{self.run_id}")
        place = scope.partition_of(F.col("kind"), F.col("period"), F.col("trade_date"), F.col("market"))
        going = hinted(self.frame([p for p in names if p not in out], "partition string"), len(names))
        of = lambda df: df.withColumn("partition", place).join(going, "partition", "left_semi")
        incoming = of(self.bars)
        existing = of(read_partitions(self.spark, self.root, old))
        pending = self.pending.join(going, "partition", "left_semi")
        keys = ("partition", "code", "trade_date")
        by_day = lambda df: group_digests(df.select("partition", *BAR_COLUMNS), *keys).withColumnRenamed("trade_date", "day")
        # Row counts now; contents are compared with the digests of the sources once they are written.
        found = incoming.groupBy("partition", "code", F.col("trade_date").alias("day")).agg(F.count("*").alias("rows"))
        torn = changes.classify_days(found, pending.select(*found.columns), ("partition", "code", "day"), ("rows",)).where("change <> 'reused'")
        facts = torn.select("partition", F.lit("staging-readback-mismatch").alias("fact"))
        if self.action == "verify":
            pick = ["partition", *BAR_COLUMNS]
            same = merge.same_keys(existing.select(*pick), incoming.select(*pick), keys)
            facts = facts.unionByName(merge.differing(same, incoming.select(*pick)).select("partition", F.lit("source-output-mismatch").alias("fact")))
        elif old:
            lost = merge.removed_records(existing, incoming, keys, ("partition", "code", "timestamp"))
            facts = facts.unionByName(lost.select("partition", F.lit("removed-records").alias("fact")))
        for r in facts.distinct().orderBy(F.col("fact") != "staging-readback-mismatch").collect():
            out.setdefault(r["partition"], BarError(r["fact"]))
        if self.action == "verify":
            return {p: out.get(p, ()) for p in names}
        merged = merge.replace_days(existing, incoming.select(*existing.columns), keys) if old else incoming
        bad = hinted(self.frame(out, "partition string"), len(out))
        write_partitions(merged.join(bad, "partition", "left_anti").drop("partition"), stage / "data")
        return out | self._read_back(stage, [p for p in names if p not in out], by_day, hashes)

    def _read_back(self, stage: Path, names: list[str], by_day, hashes: dict) -> dict[str, object]:
        """Digest every written day again and compare it with what the sources and the state say."""
        if not names:
            return {}
        place = scope.partition_of(F.col("kind"), F.col("period"), F.col("trade_date"), F.col("market"))
        written = by_day(read_partitions(self.spark, stage, names).withColumn("partition", place))
        going = hinted(self.frame(names, "partition string"), len(names))
        columns = ("partition", "code", "day", "digest", "rows")
        pending = self.pending.join(going, "partition", "left_semi").select("source", *columns)
        kept = self.days.join(going, "partition", "left_semi").select("source", *columns).join(pending.select("source", "day"), ["source", "day"], "left_anti")
        expected = kept.unionByName(pending).select(*columns)
        torn = changes.classify_days(written, expected, ("partition", "code", "day"), ("digest", "rows")).where("change <> 'reused'")
        facts = torn.select("partition", F.lit(None).cast("string").alias("digest")).distinct().unionByName(merged_digest(expected, "partition"))
        wrong, digests = set(), {}
        for r in facts.collect():
            wrong.update([r["partition"]] if r["digest"] is None else ())
            digests.update({r["partition"]: r["digest"]} if r["digest"] else {})
        fresh = folder_hashes(self.spark, {p: stage / p for p in names})
        out: dict[str, object] = {}
        for p in names:
            sound = p not in wrong and p in fresh
            out[p] = ((stage / p), (hashes.get(p), fresh[p]), digests[p]) if sound else BarError("readback-mismatch")
        return out

    # -- completion ----------------------------------------------------------

    def complete_phase(self) -> None:
        """Re-check outputs and sources at the end of the run, then grant completion and receipts."""
        self.check_cancel()
        meta, request = self.state.meta, self.request
        mine = self.frame([*self.candidates, *self.reused])
        overlap = scope.partition_overlaps(F.col("day"), F.col("period"), *request.bounds)
        rows = self.days.join(mine, "source", "left_semi").where(overlap).select("source", "partition")
        if self.candidates:
            rows = rows.unionByName(self.manifest.join(self.frame(self.candidates), "source", "left_semi").select("source", "partition"))
        facts = rows.select("source", F.lit("partition").alias("fact"), F.col("partition").alias("value")).distinct()
        if self.candidates:
            held = self.days.join(mine, "source", "left_semi").groupBy("source").agg(F.count("*").cast("string").alias("value"))
            open_days = self.pending.join(self.days.select("source", "day", "raw_hash"), ["source", "day", "raw_hash"], "left_anti").select("source").distinct()
            facts = facts.unionByName(held.select("source", F.lit("days").alias("fact"), "value")).unionByName(open_days.select("source", F.lit("open").alias("fact"), F.lit("").alias("value")))
        relevant: dict[str, set[str]] = {}
        counts, unpublished = {}, set()
        for r in facts.collect():
            if r["fact"] == "partition":
                relevant.setdefault(r["source"], set()).add(r["value"])
            elif r["fact"] == "days":
                counts[r["source"]] = int(r["value"])
            else:
                unpublished.add(r["source"])
        suspect = {}
        for p in sorted(set().union(*relevant.values()) - self.blocked if relevant else ()):
            try:
                path = safe_path(self.root, p)
                if p not in meta["partitions"]:
                    raise BarError("output-missing-or-untracked")
                if folder_signature(path) != meta["partitions"][p]["signature"]:
                    suspect[p] = path
            except (BarError, OSError) as exc:
                self.log.issue(exc, p)
                self.blocked.add(p)
        found = folder_hashes(self.spark, suspect)
        for p in suspect:
            if found.get(p) != meta["partitions"][p]["sha256"]:
                self.log.issue("output-tampered", p)
                self.blocked.add(p)
        for name, (counter, days) in self.reused.items():
            self.check_cancel()
            if not self._unchanged(name) or relevant.get(name, set()) & self.blocked:
                self.counts[counter] -= 1
                self.counts["reused_days"] -= days
        fresh = [n for n in self.sources if n not in meta["sources"]]
        if not self.candidates and not fresh:
            return
        granted = []
        for name, c in self.candidates.items():
            self.check_cancel()
            s = self.sources[name]
            sound = name not in unpublished and not self.evidence_failed and not relevant.get(name, set()) & self.blocked and self._group(name) not in self.blocked_groups
            if sound and self._unchanged(name):
                whole = not request.bounded and counts.get(name, 0) == c["day_count"]
                meta["sources"][name] = {**{k: s[k] for k in ("code", "market", "period", "kind")}, "signature": s["signature"], "sha256": self.identity[name]["sha256"], "complete": whole, "day_count": c["day_count"]}
                granted.append(name)
        for name in fresh:
            unread = {**{k: self.sources[name][k] for k in ("code", "market", "period", "kind")}, "signature": None, "sha256": None, "complete": False, "day_count": 0}
            meta["sources"].setdefault(name, unread)
        self._grant_receipts(granted)

    def _unchanged(self, name: str) -> bool:
        try:
            check_sources(self.request.source, [self.identity[name]])
            return True
        except (BarError, OSError) as exc:
            self.log.issue(exc, self.request.source / name)
            return False

    def _grant_receipts(self, granted: list[str]) -> None:
        """Commit what completion changed; a bounded run's sound sources get receipts. One of another content is never matched again."""
        if not (self.request.bounded and granted):
            self.state.commit()
            return
        meta, (start, end) = self.state.meta, self.request.bounds
        rows = []
        for name in granted:
            s = meta["sources"][name]
            rows.append((name, start, end, _canonical(s["signature"]), s["sha256"], RULE_VERSION, VALIDATION_VERSION, json.dumps(self.candidates[name]["warnings"])))
        days = self.manifest.join(hinted(self.frame(granted), len(granted)), "source", "left_semi").withColumns({"start": F.lit(start), "end": F.lit(end)})
        self.state.commit(receipts=local_frame(self.spark, rows, RECEIPTS_SCHEMA), receipt_days=days.select(*self.state.table("receipt_days").columns))

    def clean(self) -> None:
        """Staging of this run goes unless a journal still needs it."""
        if not any(safe_path(self.root, ".journal").glob("*.json")):
            shutil.rmtree(safe_path(self.root, f".staging/{self.run_id}"), ignore_errors=True)


def _canonical(signature: dict) -> str:
    return json.dumps(signature, sort_keys=True)


def _price_details(s: dict, row) -> dict:
    rows = [{"record": x["record"], "date": x["datetime"][:10], **{k: x[k] for k in ("datetime", "open", "high", "low", "close")}} for x in row["rows"]]
    return {"code": s["code"], "period": s["period"], "count": row["count"], "blocking": row["blocking"], "days": list(row["days"]), "rows": rows}


def run(spark: SparkSession, request: Request, action: str = "convert", progress=None, cancel=None) -> dict:
    """Do the action and return its report, which is also written below the output unless that is refused."""
    report = {
        "status": "complete", "run_id": uuid.uuid4().hex, "action": action,
        "scope": {"source": str(request.source), "output": str(request.output), "periods": list(request.periods), "codes": list(request.codes), "start": request.start, "end": request.end, "mode": request.mode},
        "elapsed_seconds": 0.0, "timings": {}, "issue_counts": dict.fromkeys(("error", "warning", "excluded", "malformed"), 0),
        "counts": dict.fromkeys(COUNTERS, 0), "issues": [],
        "paths": {"source": str(request.source), "output": str(request.output), "report": None, "text_report": None}, "verification": unverified(),
    }
    log = RunLog(report, progress)
    consistency = report["verification"]["conversion_consistency"]
    consistency["validation_scope"] = {"start": request.start, "end": request.end}
    try:
        log.phase("scan")
        if action not in ("convert", "scan", "verify"):
            raise BarError("invalid-action")
        sources, rejects = scan_sources(spark, request)
        request = replace(request, source=request.source.resolve(strict=True), output=request.output.absolute())
        log.issues(rejects)
        report["counts"]["source_files"] = len(sources)
        with output_lock(request.output):
            root = own_output(request)
            job = Run(spark, request, action, report, log, cancel)
            try:
                job.check_cancel()
                log.emit("scan_complete", source_files=len(sources), issue_count=len(rejects))
                if job.check_phase(root, sources):
                    try:
                        job.source_phase()
                        job.publish_phase()
                        if action == "convert":
                            job.complete_phase()
                        errors = any(i["category"] == "error" for i in report["issues"])
                        consistency.update(
                            status="failed" if errors else "verified" if sources else "unverified",
                            method="content-comparison" if action == "verify" else "readback-and-cached-fingerprints",
                            **{k: report["counts"][k] for k in ("stat_reused_files", "scope_reused_files", "content_revalidated_files")},
                        )
                    finally:
                        job.clean()
                if any(i["category"] == "error" for i in report["issues"]):
                    report["status"] = "partial"
            except Cancelled:
                report["status"] = "cancelled"
            except FAILURES as exc:
                report["status"] = "failed"
                log.issue(_first_line(exc))
            log.phase("report")
            report["paths"] |= {"report": str(safe_path(root, f"reports/{report['run_id']}.json")), "text_report": str(safe_path(root, f"reports/{report['run_id']}.txt"))}
            log.close()
            write_text_report(Path(report["paths"]["text_report"]), report)
            write_json(Path(report["paths"]["report"]), report)
    except FAILURES as exc:
        report["status"] = "failed"
        report["paths"]["report"] = None
        log.issue(_first_line(exc))
    finally:
        log.close()
    return report


def _first_line(exc: Exception):
    return exc if isinstance(exc, BarError) else str(exc).splitlines()[0] if str(exc) else type(exc).__name__
