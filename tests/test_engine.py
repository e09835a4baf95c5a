"""The whole dataflow on small trees of record files."""

import json
from dataclasses import replace

import pytest

from barloom.config import Request
from barloom.plans.engine import run
from tests.conftest import row, write_dat

DAY = 86400


@pytest.fixture
def setup(tmp_path):
    source = write_dat(tmp_path / "install/datadir/SH/86400/600000.DAT", row(), row(DAY))
    request = Request(source.parents[2], tmp_path / "output", periods=("1d",))
    return request, source, tmp_path / "output/data/kind=stock/period=1d/bucket=202609/market=SH"


def closes(spark, target):
    return [r["close"] for r in spark.read.parquet(str(target)).orderBy("code", "timestamp").collect()]


def reasons(report):
    return " ".join(i["reason"] for i in report["issues"])


def content(target):
    return {p.name: p.read_bytes() for p in target.glob("*.parquet")}


def test_full_then_incremental_then_append_and_correction(spark, setup):
    request, source, target = setup
    first = run(spark, replace(request, mode="full"))
    assert (first["status"], first["counts"]["new_days"], first["counts"]["written_partitions"]) == ("complete", 2, 1), first["issues"]
    before = content(target)
    second = run(spark, request)
    assert (second["counts"]["written_partitions"], second["counts"]["reused_days"], second["counts"]["stat_reused_files"]) == (0, 2, 1)
    assert content(target) == before
    assert json.loads(open(second["paths"]["report"], encoding="utf-8").read()) == second
    write_dat(source, row(), row(DAY), row(2 * DAY))
    third = run(spark, request)
    assert (third["counts"]["new_days"], third["counts"]["reused_days"]) == (1, 2)
    write_dat(source, row(w4=7200), row(DAY), row(2 * DAY))
    fourth = run(spark, request)
    assert (fourth["counts"]["revised_days"], fourth["counts"]["reused_days"]) == (1, 2)
    assert closes(spark, target) == [7.2, 7.25, 7.25]


def test_ranges_join_to_the_whole_and_are_reused(spark, setup):
    request, source, target = setup
    write_dat(source.with_name("600001.DAT"), row())
    day = replace(request, mode="range", start="20260922", end="20260922")
    assert run(spark, day)["status"] == "complete"
    assert run(spark, replace(request, mode="range", start="20260923", end="20260927"))["status"] == "complete"
    assert len(closes(spark, target)) == 3
    again = run(spark, day)
    assert (again["counts"]["content_revalidated_files"], again["counts"]["scope_reused_files"], again["counts"]["written_partitions"]) == (0, 2, 0)


@pytest.mark.parametrize("change", ["delete", "shrink", "invalid"])
def test_lost_sources_keep_the_partition(spark, setup, change):
    request, source, target = setup
    run(spark, request)
    before = content(target)
    if change == "delete":
        source.unlink()
    elif change == "shrink":
        write_dat(source, row())
    else:
        source.write_bytes(b"wrong header" + source.read_bytes()[12:])
    report = run(spark, request)
    assert (report["status"], report["counts"]["written_partitions"]) == ("partial", 0)
    assert content(target) == before


def test_bad_source_blocks_the_shared_partition(spark, setup):
    request, source, target = setup
    other = write_dat(source.with_name("600001.DAT"), row())
    run(spark, request)
    before = content(target)
    source.write_bytes(b"bad")
    write_dat(other, row(w4=7200))
    report = run(spark, request)
    assert report["status"] == "partial" and content(target) == before
    assert any(i.get("blocking_codes") == ["600000.SH"] for i in report["issues"])


def test_tampering_is_found_and_left(spark, setup):
    request, _, target = setup
    run(spark, request)
    part = next(target.glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    report = run(spark, request, "verify")
    assert report["status"] == "partial" and "output-tampered" in reasons(report)


def test_verify_compares_content(spark, setup):
    request, source, target = setup
    run(spark, request)
    good = run(spark, request, "verify")
    assert (good["status"], good["counts"]["content_verified_partitions"]) == ("complete", 1), good["issues"]
    write_dat(source, row(w4=7200), row(DAY))
    bad = run(spark, request, "verify")
    assert bad["status"] == "partial" and "source-output-mismatch" in reasons(bad)


def test_scope_decides_whether_bad_prices_block(spark, setup):
    request, source, target = setup
    old = (765388800, 6060, 6000, 5610, 5700, *row()[5:])
    write_dat(source, old, row())
    inside = run(spark, request)
    assert inside["status"] == "partial" and "invalid-ohlc" in reasons(inside) and not target.exists()
    scoped = run(spark, replace(request, mode="range", start="20260922", end="20260922"))
    assert scoped["status"] == "complete" and "invalid-ohlc-outside-scope" in reasons(scoped)
    assert closes(spark, target) == [7.25]


def test_scan_cancel_and_foreign_output(spark, setup, tmp_path):
    request, _, target = setup
    events = []
    scanned = run(spark, request, "scan", progress=events.append)
    assert scanned["counts"]["source_files"] == 1 and not target.exists() and json.dumps(events)
    assert run(spark, request, cancel=lambda: True)["status"] == "cancelled"
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    (foreign / "mine.txt").write_text("x")
    refused = run(spark, replace(request, output=foreign))
    assert refused["status"] == "failed" and "unowned-output" in reasons(refused)


def test_indexes_and_minutes_are_apart(spark, setup):
    request, _, _ = setup
    write_dat(request.source / "SH/86400/000001.DAT", row())
    write_dat(request.source / "SH/60/600000.DAT", row(), row(60))
    assert run(spark, replace(request, periods=("1d", "1m")))["status"] == "complete"
    data = request.output / "data"
    assert (data / "kind=index/period=1d/bucket=202609/market=SH").is_dir()
    minutes = spark.read.parquet(str(data / "kind=stock/period=1m/bucket=20260922/market=SH"))
    assert [r["minute"] for r in minutes.orderBy("timestamp").collect()] == ["11:00", "11:01"]
    write_dat(request.source / "SH/60/600000.DAT", row(), row(120))
    report = run(spark, replace(request, periods=("1m",)))
    assert report["status"] == "partial" and "removed-records" in reasons(report)


@pytest.mark.parametrize("change_source", [False, True])
def test_crash_between_rename_and_commit_is_recovered(spark, setup, monkeypatch, change_source):
    from barloom.plans import engine

    request, source, target = setup
    run(spark, request)
    before = closes(spark, target)
    write_dat(source, row(w4=7200), row(DAY))

    def crash(*_):
        raise OSError("crash before the state is written")

    with monkeypatch.context() as patch:
        patch.setattr(engine, "commit_published", crash)
        assert run(spark, request)["status"] == "failed"
    if change_source:
        source.write_bytes(b"bad")
        report = run(spark, request)
        assert report["status"] == "partial" and "recovery-rejected" in reasons(report)
        assert closes(spark, target) == before
    else:
        report = run(spark, request)
        assert (report["status"], report["counts"]["recovered_partitions"], report["counts"]["recovery_revalidated_files"]) == ("complete", 1, 1), report["issues"]
        assert closes(spark, target) == [7.2, 7.25]


@pytest.mark.parametrize("close,status", [(7.25, "complete"), (8.0, "partial")])
def test_evidence_decides_publication(spark, setup, tmp_path, close, status):
    request, _, target = setup
    item = {"code": "600000.SH", "period": "1d", "timestamp": row()[0] * 1000, "fields": {"close": close, "volume": 1234, "code": "600000.SH"}}
    path = tmp_path / "evidence.json"
    path.write_text(json.dumps({"version": 1, "source": {"description": "made up", "sha256": "0" * 64, "provenance": "same-source"}, "comparisons": [item]}))
    report = run(spark, replace(request, evidence=path))
    assert report["status"] == status and target.exists() == (status == "complete")
    assert report["verification"]["external_evidence"]["matched"] == (status == "complete")


def test_reading_is_cancelled_and_told_of(spark, setup):
    request, source, target = setup
    events = []
    report = run(spark, request, progress=events.append, cancel=lambda: any(e["event"] == "source" for e in events))
    assert report["status"] == "cancelled" and not target.exists()
    report = run(spark, request, progress=events.append)
    assert report["status"] == "complete" and [e["phase"] for e in events if e["event"] == "phase"][-5:] == ["scan", "check", "source", "publish", "report"]
    assert sum(report["timings"].values()) <= report["elapsed_seconds"] + 0.01
    assert all("issue_counts" in e and "counts" in e for e in events if e["event"].endswith("_complete"))


@pytest.mark.parametrize("when", ["after the listing", "before the read", "link"])
def test_a_source_that_is_not_the_listed_file_is_refused(spark, setup, monkeypatch, when):
    from barloom.plans import engine

    request, source, target = setup
    other = write_dat(source.with_name("600001.DAT"), row(40 * DAY))
    listed, reading = engine.scan_sources, engine.Run._in_background

    def replaced():
        if when == "link":
            source.unlink()
            source.symlink_to(write_dat(request.output.parent / "elsewhere/600000.DAT", row(), row(DAY)))
        else:
            write_dat(source.with_suffix(".new"), row(), row(DAY), row(2 * DAY)).replace(source)

    def listing(*args):
        found = listed(*args)
        replaced()
        return found

    def background(self, *args):
        replaced()
        return reading(self, *args)

    if when == "before the read":
        monkeypatch.setattr(engine.Run, "_in_background", background)
    else:
        monkeypatch.setattr(engine, "scan_sources", listing)
    report = run(spark, request)
    assert report["status"] == "partial" and ("source-link" if when == "link" else f"source-changed: {source}") in reasons(report)
    assert report["counts"]["content_revalidated_files"] == 1 and not target.exists()
    # Without history the group is blocked as a whole; the next run reads what is there now.
    monkeypatch.undo()
    if when != "link":
        assert run(spark, request)["status"] == "complete" and len(closes(spark, target)) == 3
    assert other.exists()


def test_errors_are_told_while_later_files_are_read(spark, setup):
    request, source, _ = setup
    write_dat(source, row(w2=7100))
    many = [write_dat(source.with_name(f"6000{k:02d}.DAT"), *(row(j * DAY) for j in range(3))) for k in range(1, 60)]
    events, reading = [], []

    def listen(event):
        events.append(event)
        if event["event"] == "issue":
            reading.append(any(request.output.glob(".staging/*/read/_SUCCESS")))

    report = run(spark, request, progress=listen)
    kinds = [(e["event"], e.get("index")) for e in events]
    at = next(i for i, e in enumerate(events) if e["event"] == "issue")
    assert kinds.index(("source", 1)) < at < kinds.index(("source_complete", 1)) < kinds.index(("source", 2))
    assert reading[0] is False
    assert events[at]["issue"] in report["issues"] and events[at]["issue"]["rows"][0]["high"] == 7.1
    told = [e["index"] for e in events if e["event"] == "source_complete"]
    assert told == list(range(1, len(many) + 2)) and report["status"] == "partial"


def test_receipts_cover_narrower_days_of_unchanged_files_only(spark, setup, monkeypatch):
    from barloom.plans import engine

    request, source, target = setup
    write_dat(source, *(row(k * DAY) for k in range(4)))
    scoped = lambda start, end, **more: replace(request, mode="range", start=start, end=end, **more)
    told = lambda report: (report["status"], report["counts"]["scope_reused_files"], report["counts"]["content_revalidated_files"])
    assert told(run(spark, scoped("20260922", "20260924"))) == ("complete", 0, 1)
    assert told(run(spark, scoped("20260923", "20260924"))) == ("complete", 1, 0)
    # A day beyond the receipt, a full run and a comparison read the file again, as does another version of the rules.
    assert told(run(spark, scoped("20260923", "20260925"))) == ("complete", 0, 1)
    assert told(run(spark, scoped("20260923", "20260924"), "verify")) == ("complete", 0, 1)
    assert told(run(spark, replace(request, mode="full"))) == ("complete", 0, 1)
    monkeypatch.setattr(engine, "VALIDATION_VERSION", "another")
    assert told(run(spark, scoped("20260922", "20260924"))) == ("complete", 0, 1)
    monkeypatch.undo()
    # So does an output that no longer is what was published.
    part = next(target.glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    report = run(spark, scoped("20260922", "20260924"))
    assert report["status"] == "partial" and "output-tampered" in reasons(report) and report["counts"]["scope_reused_files"] == 0


def test_a_bad_day_blocks_its_partition_for_all_codes(spark, setup):
    request, source, target = setup
    other = write_dat(source.with_name("600001.DAT"), row(), row(40 * DAY))
    assert run(spark, request)["status"] == "complete"
    write_dat(source, row(w2=7100), row(DAY))
    write_dat(other, row(w4=7200), row(40 * DAY, w4=7200))
    report = run(spark, request)
    assert report["status"] == "partial" and closes(spark, target) == [7.25] * 3
    later = target.parent.parent / "bucket=202611/market=SH"
    assert closes(spark, later) == [7.2]


def test_other_processes_and_abandoned_staging(spark, setup):
    import subprocess
    import sys

    request, _, target = setup
    assert run(spark, request)["status"] == "complete"
    hold = "import fcntl, sys; f = open(sys.argv[1], 'a'); fcntl.flock(f, fcntl.LOCK_EX); print('held', flush=True); sys.stdin.read()"
    with subprocess.Popen([sys.executable, "-c", hold, str(request.output / ".barloom.lock")], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as other:
        assert other.stdout.readline() == b"held\n"
        refused = run(spark, request)
        assert refused["status"] == "failed" and "output-locked" in reasons(refused)
        other.stdin.close()
    left = request.output / ".staging/abandoned/data"
    left.mkdir(parents=True)
    assert run(spark, request)["status"] == "complete" and not left.exists()
    (request.output / ".journal/x.json").write_text("{}")
    assert "pending-recovery" in reasons(run(spark, request, "verify"))


def test_files_of_a_partition_are_sorted_and_plain(spark, setup):
    import pyarrow.parquet as pq

    request, source, target = setup
    write_dat(source.with_name("600001.DAT"), row(), row(DAY))
    run(spark, request)
    (part,) = target.glob("*.parquet")
    meta, table = pq.read_metadata(part), pq.read_table(part, partitioning=None)
    chunk = meta.row_group(0).column(0)
    assert chunk.compression == "SNAPPY" and not chunk.has_dictionary_page and not list(target.glob(".*.crc"))
    keys = list(zip(table["code"].to_pylist(), table["timestamp"].to_pylist()))
    assert keys == sorted(keys) and len(keys) == 4


def test_a_schema_that_is_not_ours_is_found(spark, setup, tmp_path):
    from barloom.publish import misfits

    request, _, target = setup
    run(spark, request)
    name = str(target.relative_to(request.output))
    assert misfits(spark, request.output, [name]) == []
    import pyarrow as pa
    import pyarrow.parquet as pq

    (part,) = target.glob("*.parquet")
    sound = pq.ParquetFile(part).read()
    with_null = sound.set_column(11, "amount", pa.array([None, 1.0], pa.float64()))
    for table in (sound.select(sound.column_names[::-1]), with_null, sound.set_column(10, "volume", sound["volume"].cast("int32"))):
        pq.write_table(table, part)
        assert misfits(spark, request.output, [name]) == [name]
    pq.write_table(with_null, part, write_statistics=False)
    assert misfits(spark, request.output, [name]) == [name]
    pq.write_table(sound, part)
    assert misfits(spark, request.output, [name]) == []
    spark.range(1).write.mode("overwrite").parquet(str(target))
    assert misfits(spark, request.output, [name]) == [name]
