"""State in parts, receipts by intervals, and recovery from a crash at any point."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from barloom import publish, state
from barloom.config import Request
from barloom.errors import BarError
from barloom.operators import changes
from barloom.plans import engine
from barloom.plans.engine import run
from barloom.schema import DAYS_SCHEMA
from barloom.state import State
from tests.conftest import row, write_dat
from tests.test_engine import DAY, closes, reasons


@pytest.fixture
def setup(tmp_path):
    source = write_dat(tmp_path / "install/datadir/SH/86400/600000.DAT", row(), row(DAY))
    request = Request(source.parents[2], tmp_path / "output", periods=("1d",))
    return request, source, tmp_path / "output/data/kind=stock/period=1d/bucket=202609/market=SH"


@pytest.fixture
def root(tmp_path):
    (tmp_path / ".state").mkdir()
    return tmp_path


def days(spark, rows):
    made = [(s, "600000.SH", "SH", "1d", "stock", d, mark, mark, 1, "v", "p") for s, d, mark in rows]
    return spark.createDataFrame(made, DAYS_SCHEMA)


def held(st):
    return {(r["source"], r["day"]): r["raw_hash"] for r in st.days.collect()}


def size(root):
    return sum(p.stat().st_size for p in root.rglob("*.parquet"))


def test_a_commit_writes_what_changed_and_later_parts_win(spark, root):
    st = State(spark, root)
    st.commit(days=days(spark, [(f"s{k % 50}", f"{k:08d}", f"first {k}") for k in range(20_000)]))
    whole = size(root)
    st.commit(days=days(spark, [("s1", "00000001", "second"), ("s1", "99999999", "new")]))
    st.commit(days=days(spark, [("s1", "00000001", "third")]))
    assert size(root) - whole < whole / 20
    again = State(spark, root)
    found = held(again)
    assert len(found) == 20_001 and found["s1", "00000001"] == "third" and found["s1", "99999999"] == "new" and found["s2", "00000002"] == "first 2"
    assert [p["rows"] for p in again.meta["parts"]["days"]] == [20_000, 2, 1]
    # A commit without rows has no part.
    again.commit(days=again.days.limit(0))
    assert len(again.meta["parts"]["days"]) == 3 and held(State(spark, root)) == found


def test_parts_are_put_together(spark, root, monkeypatch):
    monkeypatch.setattr(state, "MOST_PARTS", 3)
    st, expected = State(spark, root), {}
    for k in range(8):
        fresh = {("s", f"{d:08d}"): f"{k}" for d in range(k, k + 3)}
        expected |= fresh
        st.commit(days=days(spark, [(*key, v) for key, v in fresh.items()]))
        assert held(st) == expected and len(st.meta["parts"]["days"]) <= 3
    named = {p["name"] for p in st.meta["parts"]["days"]}
    assert named <= {p.name for p in (root / ".state").iterdir()} and len(list((root / ".state").glob("days-*"))) <= 5


def test_a_crash_before_the_switch_leaves_the_old_version(spark, root, monkeypatch):
    st = State(spark, root)
    st.commit(days=days(spark, [("s", "1", "a")]))

    def crash(*_):
        raise OSError("crash before the switch")

    with monkeypatch.context() as patch:
        patch.setattr(state, "write_text", crash)
        with pytest.raises(OSError):
            st.commit(days=days(spark, [("s", "1", "lost"), ("s", "2", "lost")]))
    again = State(spark, root)
    assert held(again) == {("s", "1"): "a"}
    again.commit(days=days(spark, [("s", "3", "b")]))
    assert held(State(spark, root)) == {("s", "1"): "a", ("s", "3"): "b"}


def test_first_covering_receipt_against_brute_force(spark):
    rng = random.Random(3)
    day = lambda k: f"2026{1 + k // 28:02d}{1 + k % 28:02d}"

    def intervals(n, keys):
        out = {(rng.choice(keys), a, min(a + rng.randrange(60), 330)) for a in (rng.randrange(300) for _ in range(n))}
        return sorted((k, day(a), day(b)) for k, a, b in out)

    receipts, asked = intervals(150, "abc"), intervals(200, "abcd")
    found = {(r["source"], r["start"], r["end"]): (r["receipt_start"], r["receipt_end"], r["note"]) for r in changes.first_covering(
        spark.createDataFrame(asked, "source string, start string, end string"),
        spark.createDataFrame([(*r, "-".join(r)) for r in receipts], "source string, start string, end string, note string"), carry=("note",),
    ).collect()}
    expected = {}
    for k, a, b in asked:
        around = [(s, e, f"{k}-{s}-{e}") for key, s, e in receipts if key == k and s <= a and e >= b]
        if around:
            expected[k, a, b] = min(around)
    assert found == expected and len(expected) > 30


def test_a_million_receipts_of_one_source(spark):
    """Their number is no join of intervals: each request finds its own in a running minimum."""
    n = 1_000_000
    text = lambda c: F.lpad(c.cast("string"), 8, "0")
    receipts = spark.range(n).select(F.lit("s").alias("source"), text(F.col("id") * 7).alias("start"), text(F.col("id") * 7 + 20).alias("end"))
    asked = spark.range(0, n, 1000).select(F.lit("s").alias("source"), text(F.col("id") * 7 + 10).alias("start"), text(F.col("id") * 7 + 12).alias("end"))
    rows = changes.first_covering(asked, receipts)
    wrong = rows.where(F.col("receipt_start").cast("long") != F.greatest(F.lit(0), F.col("start").cast("long") - 10 - 7))
    assert rows.count() == n // 1000 and wrong.count() == 0


# -- recovery ----------------------------------------------------------------


def crashed(spark, request, monkeypatch, at):
    """A run that ends as the process would at some point of publication."""

    def crash(*_):
        raise OSError("crash")

    with monkeypatch.context() as patch:
        if at == "before the state":
            patch.setattr(engine, "commit_published", crash)
        elif at == "after the state":
            patch.setattr(engine, "forget", crash)
        elif at == "between the renames":
            real, seen = publish.os.replace, []

            def one(a, b):
                seen.append(b)
                if "data" in str(a) and ".staging" in str(a):
                    raise OSError("crash")
                return real(a, b)

            patch.setattr(publish.os, "replace", one)
        return run(spark, request)


def test_an_established_revision_outlives_a_changed_source(spark, setup, monkeypatch):
    request, source, target = setup
    run(spark, request)
    write_dat(source, row(w4=7200), row(DAY))
    assert crashed(spark, request, monkeypatch, "after the state")["status"] == "failed"
    assert list((request.output / ".journal").glob("*.json"))
    source.write_bytes(b"bad")
    report = run(spark, request)
    assert report["status"] == "partial" and closes(spark, target) == [7.2, 7.25]
    told = [i for i in report["issues"] if i["reason"].startswith("source-changed-since-committed-publication")]
    assert [i["category"] for i in told] == ["warning"] and report["counts"]["recovered_partitions"] == 1
    assert not list((request.output / ".journal").glob("*.json"))


def test_a_journal_after_its_commit_is_only_forgotten(spark, setup, monkeypatch):
    request, source, target = setup
    assert crashed(spark, request, monkeypatch, "after the state")["status"] == "failed"
    version = (request.output / ".state/CURRENT").read_text()
    journal = json.loads(next((request.output / ".journal").glob("*.json")).read_text())
    report = run(spark, request)
    assert report["status"] == "complete" and report["counts"]["recovered_partitions"] == 1 and report["counts"]["recovery_revalidated_files"] == 1
    assert report["counts"]["written_partitions"] == 0 and int((request.output / ".state/CURRENT").read_text()) <= int(version) + 1
    # The journal's digest is that of the content, which one job makes again.
    assert publish.content_digests(spark, request.output, [journal["partition"]]) == {journal["partition"]: journal["digest"]}


def test_a_crash_between_the_renames_puts_the_old_folder_back(spark, setup, monkeypatch):
    request, source, target = setup
    run(spark, request)
    write_dat(source, row(w4=7200), row(DAY))
    # Publication tells of the failed rename and ends with what it has; the journal and the backup stay.
    assert crashed(spark, request, monkeypatch, "between the renames")["status"] == "partial" and not target.exists()
    report = run(spark, request)
    assert report["status"] == "complete" and closes(spark, target) == [7.2, 7.25], report["issues"]


@pytest.mark.parametrize("how,reason", [("digest", "recovery-readback-mismatch"), ("output", "recovery-output-tampered"), ("journal", "invalid-recovery-journal"), ("backup", "recovery-backup-missing-or-tampered")])
def test_recovery_stops_at_what_it_cannot_explain(spark, setup, monkeypatch, how, reason):
    request, source, target = setup
    run(spark, request)
    write_dat(source, row(w4=7200), row(DAY))
    crashed(spark, request, monkeypatch, "before the state")
    (path,) = (request.output / ".journal").glob("*.json")
    journal = json.loads(path.read_text())
    if how == "digest":
        path.write_text(json.dumps({**journal, "digest": "0" * 64}))
    elif how == "journal":
        path.write_text(json.dumps({**journal, "version": 9}))
    elif how == "output":
        part = next(target.glob("*.parquet"))
        part.write_bytes(part.read_bytes() + b"x")
    else:
        source.write_bytes(b"bad")
        next((request.output / journal["backup"]).glob("*.parquet")).unlink()
    report = run(spark, request)
    assert report["status"] == "failed" and reason in reasons(report) and path.exists()


@pytest.mark.parametrize("target,had_old,backup,committed,sound,step", [
    ("new", True, True, False, True, "commit"), ("new", True, True, True, True, "keep"), ("new", True, False, True, False, "keep and warn"), ("new", True, True, False, False, "restore"),
    ("new", False, False, False, False, "quarantine"), ("new", True, False, False, False, "stop: recovery-backup-missing-or-tampered"), ("old", True, False, False, True, "nothing"),
    ("none", True, True, False, True, "put back"), ("none", False, False, False, True, "nothing"), ("none", True, False, False, True, "stop: recovery-output-tampered"), ("other", True, True, True, True, "stop: recovery-output-tampered"),
])
def test_steps_of_recovery(target, had_old, backup, committed, sound, step):
    assert publish._step(publish._Found(target, committed, backup), had_old, None if sound else BarError("x")) == step


def test_sources_are_looked_at_a_few_times_whatever_the_number_of_partitions(spark, setup, monkeypatch):
    request, source, _ = setup
    for code in ("600000", "600001"):
        write_dat(request.source / f"SH/60/{code}.DAT", *(row(k * DAY) for k in range(12)))
    looks, real = [], publish.check_readable
    monkeypatch.setattr(publish, "check_readable", lambda path, root: looks.append(path) or real(path, root))
    report = run(spark, replace(request, periods=("1d", "1m")))
    assert report["status"] == "complete" and report["counts"]["written_partitions"] == 13
    # Two sources in each of twelve partitions; the loop takes a second or two, and completion looks once more.
    assert len(looks) <= 3 * 5


def test_a_source_replaced_before_its_publication_is_not_published(spark, setup):
    request, source, target = setup

    def change(event):
        if event["event"] == "partition":
            write_dat(source, row(w4=7200), row(DAY))

    report = run(spark, request, progress=change)
    assert report["status"] == "partial" and not target.exists() and "source-changed-before-publish" in reasons(report)


# -- receipts ----------------------------------------------------------------


def scoped(request, **more):
    return replace(request, mode="range", **{"start": "20260922", "end": "20260922", **more})


def receipts(spark, request):
    return State(spark, request.output).table("receipts").count()


def test_runs_that_do_not_end_well_grant_no_receipt(spark, setup):
    request, source, target = setup
    stop = []
    cancelled = run(spark, scoped(request), progress=lambda e: stop.append(1) if e["event"] == "source_complete" else None, cancel=lambda: bool(stop))
    assert cancelled["status"] == "cancelled" and receipts(spark, request) == 0

    def tamper(event):
        if event["event"] == "partition_complete":
            for part in (request.output / event["path"]).glob("*.parquet"):
                part.write_bytes(b"changed after publication")

    report = run(spark, scoped(request), progress=tamper)
    assert report["status"] == "partial" and receipts(spark, request) == 0


def test_a_failed_shared_partition_grants_no_receipt_to_others(spark, setup):
    request, source, _ = setup
    write_dat(source.with_name("600001.DAT"), row(w1=7400))
    report = run(spark, scoped(request))
    assert (report["status"], report["counts"]["written_partitions"], receipts(spark, request)) == ("partial", 0, 0)


@pytest.mark.parametrize("what", ["output", "source"])
def test_reused_sources_are_checked_again_at_the_end(spark, setup, what):
    request, source, target = setup
    assert run(spark, scoped(request))["status"] == "complete" and receipts(spark, request) == 1

    def change(event):
        if event["event"] == "source_complete":
            if what == "source":
                write_dat(source, row(w4=7200), row(DAY))
            else:
                next(target.glob("*.parquet")).write_bytes(b"changed after the first check")

    report = run(spark, scoped(request), progress=change)
    assert report["status"] == "partial" and report["counts"]["scope_reused_files"] == 0 and report["counts"]["reused_days"] == 0
    assert ("output-tampered" if what == "output" else "source-changed-before-publish") in reasons(report)


def test_cached_days_must_be_those_of_the_receipt(spark, setup):
    request, source, _ = setup
    assert run(spark, scoped(request))["status"] == "complete"
    st = State(spark, request.output)
    assert st.table("receipt_days").first()["preclose_raw"] == [7000]
    st.commit(days=st.days.withColumn("digest", F.lit("uncorroborated")))
    report = run(spark, scoped(request))
    assert (report["counts"]["scope_reused_files"], report["counts"]["content_revalidated_files"]) == (0, 1)
