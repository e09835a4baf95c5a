"""The tree as a stream of listings."""

from dataclasses import replace

from barloom.config import Request
from barloom.plans.engine import run
from barloom.state import State
from barloom.streaming.follow import ListingVersions, changes_between, follow
from tests.conftest import row, write_dat
from tests.test_engine import DAY


def rows(spark, output):
    return sorted(map(tuple, spark.read.parquet(str(output / "data")).collect()))


def days(spark, output):
    return sorted((r["source"], r["day"], r["raw_hash"], r["digest"], r["rows"]) for r in State(spark, output).days.collect())


def test_listings_have_versions(tmp_path):
    versions = ListingVersions(tmp_path / "listings")
    a, b = {"x": {"size": 1, "inode": 1}}, {"x": {"size": 2, "inode": 1}, "y": {"size": 3, "inode": 2}}
    assert versions.take({}) == 0 and versions.take(a) == 1 == versions.take(a) and versions.take(b) == 2
    assert changes_between(versions.read(0), versions.read(1)) == [("new", "x", 1)]
    assert changes_between(versions.read(1), versions.read(2)) == [("changed", "x", 2), ("new", "y", 3)]
    assert changes_between(b, a) == [("changed", "x", 1), ("gone", "y", 3)]
    versions.forget_before(2)
    assert versions.newest() == 2 and versions.take(b) == 2


def test_batches_with_a_correction_equal_one_run(spark, tmp_path):
    one = write_dat(tmp_path / "install/datadir/SH/86400/600000.DAT", row(), row(DAY))
    two = write_dat(one.with_name("600001.DAT"), row())
    request, checkpoint, told = Request(one.parents[2], tmp_path / "output", periods=("1d",)), tmp_path / "checkpoint", []

    def batch():
        before = len(told)
        query = follow(spark, request, checkpoint, told.append, once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        return told[before:]

    (first,) = batch()
    assert (first["status"], first["counts"]["new_days"]) == ("complete", 3)
    # Started again with nothing changed, the query goes on from its offset: no run.
    assert batch() == []
    write_dat(one, row(w4=7200), row(DAY), row(2 * DAY))
    write_dat(two.with_name("600003.DAT"), row(DAY))
    (second,) = batch()
    assert (second["status"], second["counts"]["revised_days"], second["counts"]["new_days"], second["counts"]["stat_reused_files"]) == ("complete", 1, 2, 1)
    two.unlink()
    (third,) = batch()
    assert third["status"] == "partial" and any(i["reason"] == "source-missing" for i in third["issues"])
    write_dat(two, row())
    assert batch()[0]["status"] == "complete"
    whole = replace(request, output=tmp_path / "whole")
    assert run(spark, whole)["status"] == "complete"
    assert rows(spark, request.output) == rows(spark, whole.output) and days(spark, request.output) == days(spark, whole.output)
