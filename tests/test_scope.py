"""Bounded runs on files with older history, and runs that end early."""

from dataclasses import replace

import pytest

from barloom.config import Request
from barloom.plans import engine
from barloom.plans.engine import run
from barloom.state import State
from tests.conftest import row, write_dat
from tests.test_engine import DAY, closes, content, reasons

#: 4 April 1994, some decades before the base record's day, and the day after.
OLD, NEXT = 765388800, 765388800 + DAY


def old(seconds=OLD, **words):
    return (seconds, *row(**words)[1:])


@pytest.fixture
def setup(tmp_path):
    source = write_dat(tmp_path / "install/datadir/SH/86400/600000.DAT", old(), row())
    request = Request(source.parents[2], tmp_path / "output", periods=("1d",), mode="full")
    place = lambda month: request.output / f"data/kind=stock/period=1d/bucket={month}/market=SH"
    return request, source, place("199404"), place("202609")


def bounded(request, start="20260922"):
    return replace(request, mode="range", start=start, end="20260922")


def cached(spark, request):
    return {r["day"] for r in State(spark, request.output).days.collect()}


def errors(report, reason):
    return [i for i in report["issues"] if i["reason"] == reason]


def test_bounds_that_grow_onto_a_bad_day_publish_nothing(spark, setup):
    request, source, past, now = setup
    write_dat(source, old(w1=6060, w2=6000, w3=5610, w4=5700), row())
    first = run(spark, bounded(request))
    assert first["status"] == "complete" and errors(first, "invalid-ohlc-outside-scope")[0]["blocking"] is False
    before = content(now)
    report = run(spark, bounded(request, "19940404"))
    (error,) = errors(report, "invalid-ohlc")
    assert (report["status"], report["counts"]["written_partitions"]) == ("partial", 0)
    assert (error["code"], error["rows"][0]["date"], error["rows"][0]["open"]) == ("600000.SH", "1994-04-04", 6.06)
    assert content(now) == before and not past.exists() and cached(spark, request) == {"20260922"}


def test_a_narrow_run_keeps_older_days_and_notices_when_one_is_gone(spark, setup):
    request, source, past, now = setup
    assert run(spark, request)["status"] == "complete"
    kept = content(past)
    write_dat(source, old(), row(w4=7200))
    report = run(spark, bounded(request))
    assert report["status"] == "complete" and closes(spark, now) == [7.2] and content(past) == kept
    assert cached(spark, request) == {"19940404", "20260922"}
    current = content(now)
    write_dat(source, old(NEXT), row(w4=7200))
    report = run(spark, bounded(request))
    assert report["status"] == "partial" and errors(report, "removed-days") and report["counts"]["written_partitions"] == 0
    assert (content(past), content(now)) == (kept, current) and cached(spark, request) == {"19940404", "20260922"}


def test_a_bad_new_month_blocks_it_though_only_an_old_one_is_known(spark, setup):
    request, source, past, now = setup
    other = source.with_name("600001.DAT")
    for path in (source, other):
        write_dat(path, old())
    assert run(spark, request)["status"] == "complete"
    write_dat(source, old(), row(w1=7400))
    write_dat(other, old(), row())
    report = run(spark, bounded(request))
    (blocked,) = errors(report, "partition-unpublishable")
    assert report["status"] == "partial" and blocked["blocking_codes"] == ["600000.SH"] and errors(report, "invalid-ohlc")[0]["rows"][0]["date"] == "2026-09-22"
    assert report["counts"]["written_partitions"] == 0 and not now.exists() and cached(spark, request) == {"19940404"}


def test_a_bounded_run_checks_its_month_and_verify_all(spark, setup):
    request, *_ = setup
    assert run(spark, request)["status"] == "complete"
    assert run(spark, bounded(request))["counts"]["checked_partitions"] == 1
    assert run(spark, bounded(request), "verify")["counts"]["checked_partitions"] == 2


def test_a_run_cancelled_after_staging_leaves_none(spark, setup):
    request, _, past, now = setup
    stop = []
    report = run(spark, request, progress=lambda e: stop.append(1) if e["event"] == "source_complete" else None, cancel=lambda: bool(stop))
    assert report["status"] == "cancelled" and not past.exists() and not list((request.output / ".staging").rglob("*.parquet"))
    assert {"source", "report"} <= set(report["timings"])
    assert run(spark, request)["status"] == "complete"


def test_a_report_that_cannot_be_written_is_a_failure_with_its_duration(spark, setup, monkeypatch):
    request, *_ = setup
    real = engine.write_json

    def full(path, value):
        if path.parent.name == "reports":
            raise OSError("no space")
        return real(path, value)

    monkeypatch.setattr(engine, "write_json", full)
    report = run(spark, request)
    assert report["status"] == "failed" and report["paths"]["report"] is None and "no space" in reasons(report)
    assert report["timings"]["report"] >= 0 and report["elapsed_seconds"] >= sum(report["timings"].values()) - 0.01


def test_a_linked_output_folder_is_refused(spark, setup, tmp_path):
    request, *_ = setup
    run(spark, request, "scan")
    outside = tmp_path / "outside"
    outside.mkdir()
    (request.output / "data").rmdir()
    (request.output / "data").symlink_to(outside, target_is_directory=True)
    report = run(spark, request)
    assert report["status"] == "failed" and "output-link" in reasons(report) and list(outside.iterdir()) == []
