"""Units: requests, settings, decoding, digests, validation, evidence, listing."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from barloom.config import Request, Settings, iso_date, load_settings, save_settings
from barloom.errors import BarError
from barloom.functions.digest import group_digests
from barloom.operators import decode, evidence, fingerprint, scope, validate
from barloom.schema import BAR_COLUMNS
from barloom.sources.listing import scan_sources
from barloom.sources.records import file_verdicts, read_files, read_records, read_records_sql
from tests.conftest import HEADER, row, write_dat

INFO = {"source": "s", "code": "600000.SH", "market": "SH", "period": "1d", "kind": "stock"}


def records(spark, *paths):
    rows = decode.with_days(read_records(spark, [str(p) for p in paths]))
    return rows.withColumns({k: F.lit(v) for k, v in INFO.items()})


def canonical(rows):
    """The documented digest format, written out with struct."""
    out = b"qmt-business-v2\0" + struct.pack("<Q", len(rows))
    kinds = "sssssi" + "ffff" + "if"
    for k, kind in enumerate(kinds):
        values = [r[k] for r in rows]
        if kind == "s":
            raw = [v.encode() for v in values]
            at = [0]
            for v in raw:
                at.append(at[-1] + len(v))
            out += struct.pack(f"<{len(at)}i", *at) + b"".join(raw)
        else:
            out += struct.pack(f"<{len(values)}{'q' if kind == 'i' else 'd'}", *values)
    return hashlib.sha256(out).hexdigest()


def test_record_becomes_the_documented_bar_and_hashes(spark, tmp_path):
    rows = records(spark, write_dat(tmp_path / "600000.DAT", row()))
    bar = decode.to_bars(rows).select(*BAR_COLUMNS).first()
    assert tuple(bar) == ("20260922", "600000.SH", "SH", "2026-09-22 11:00:00", "11:00", 1790046000000, 7.1, 7.35, 7.0, 7.25, 1234, 4294967301.0)
    day = fingerprint.fingerprints(rows).first()
    assert day["raw_hash"] == "ae4933b3fa0aa77e43b3e297b2f14cfb9d466ce71f8223d67871c9ee836e618f"
    assert day["digest"] == "8984c7df797684640e050941bd88f771cf140a7edd715a96eed12dc1eb588e2f" == canonical([bar])
    assert day["preclose_raw"] == [7000]
    minute = fingerprint.fingerprints(rows.withColumn("period", F.lit("1m"))).first()
    assert minute["preclose_raw"] is None and minute["digest"] == day["digest"]


def test_digest_ignores_order_and_padding(spark, tmp_path):
    two = records(spark, write_dat(tmp_path / "600000.DAT", row(), row(60)))
    bars = decode.to_bars(two).select(*BAR_COLUMNS)
    found = group_digests(bars.orderBy(F.desc("timestamp")), "trade_date").first()
    assert (found["digest"], found["rows"]) == ("5d3f074c7320fdaf9450ef3d64253046c0ae6fb0cc0eba9404291507b2ffa59a", 2)
    padded = records(spark, write_dat(tmp_path / "600001.DAT", row(w10=4000000000, w11=3000000000), row(60)))
    a, b = (fingerprint.fingerprints(r).first() for r in (two, padded))
    assert a["digest"] == b["digest"] and a["raw_hash"] != b["raw_hash"]
    uneven = bars.withColumn("minute", F.when(F.col("timestamp") % 120000 == 0, "1").otherwise("22"))
    assert group_digests(uneven, "trade_date").first()["digest"] == canonical(sorted(map(tuple, uneven.collect()), key=lambda r: r[5]))


def test_groups_over_many_batches_have_the_digest_of_the_whole(spark, tmp_path):
    """Groups of one row, of some and of more than a batch, in batches of seven rows."""
    rows = [row(60 * k, w4=7200 + k % 100) for k in range(300)]
    bars = decode.to_bars(records(spark, write_dat(tmp_path / "600000.DAT", *rows)), "raw").withColumn("audit", F.col("volume"))
    bars = bars.withColumn("part", F.when(F.col("timestamp") % 1_000_000 == 0, F.col("timestamp")).otherwise(F.floor(F.col("timestamp") / 4_000_000) % 5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {r["part"]: r for r in group_digests(bars, "part", raw=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by: dict = {}
    for b in bars.orderBy("timestamp").collect():
        by.setdefault(b["part"], []).append(b)
    assert found.keys() == by.keys() and min(map(len, by.values())) == 1 < max(map(len, by.values()))
    for part, own in by.items():
        told = found[part]
        assert (told["digest"], told["rows"]) == (canonical([tuple(b[c] for c in BAR_COLUMNS) for b in own]), len(own))
        assert told["audit"] == [b["volume"] for b in own]
        assert told["raw_hash"] == hashlib.sha256(b"".join(b["raw"] for b in own)).hexdigest()


def test_null_bars_have_no_digest(spark, tmp_path):
    bars = decode.to_bars(records(spark, write_dat(tmp_path / "600000.DAT", row()))).select(*BAR_COLUMNS)
    with pytest.raises(Exception, match="digest-null-field"):
        group_digests(bars.withColumn("volume", F.lit(None).cast("long")), "trade_date").collect()


def test_sql_unpacking_equals_arrow_unpacking(spark, tmp_path):
    path = write_dat(tmp_path / "600000.DAT", row(), row(60, w6=4000000000, w9=2**21), row(120))
    files = spark.read.format("binaryFile").load(str(path)).select("path", "content")
    a = read_records_sql(files).drop("path").orderBy("rec").collect()
    b = read_records(spark, [str(path)]).select(*[c for c in read_records_sql(files).columns if c != "path"]).orderBy("rec").collect()
    assert [tuple(x) for x in a] == [tuple(x) for x in b] and a[1]["w6"] == 4000000000


def test_fixed_offset_clock(spark):
    from barloom.functions.clock import market_clock

    found = spark.range(1).select(F.date_format(market_clock(F.lit(677520000)), "yyyy-MM-dd HH:mm:ss").alias("c")).first()["c"]
    assert found == "1991-06-22 00:00:00"


@pytest.mark.parametrize("raw,reason", [
    (b"", "unknown-header"), (b"bad", "unknown-header"), (b"\0" * 8, "unknown-header"), (HEADER, "empty-dat"), (HEADER + b"x" * 63, "invalid-record-length"),
])
def test_broken_files(spark, tmp_path, raw, reason):
    path = tmp_path / "600000.DAT"
    path.write_bytes(raw)
    found = file_verdicts(read_files(spark, [str(path)])).first()
    assert (found["failure"], found["n"]) == (reason, None)


def test_verdicts_in_their_order(spark, tmp_path):
    cases = {
        "600000": ([row(60), row()], "invalid-time-order"), "600001": ([row(w2=7100)], "invalid-ohlc"), "600002": ([row(w14=1)], "unknown-status"),
        "600003": ([row(w8=1, w9=2**21)], "amount-not-exactly-representable"), "600004": ([row(w8=0, w9=2**21)], None),
        "600005": ([row(w1=7400, w14=1)], "invalid-ohlc"), "600006": ([row(w9=2**32 - 1)], "amount-not-exactly-representable"), "600007": ([row(w4=0)], "invalid-ohlc"),
    }
    paths = [write_dat(tmp_path / f"{k}.DAT", *rows) for k, (rows, _) in cases.items()]
    found = {r["path"].rsplit("/", 1)[1][:6]: r["failure"] for r in file_verdicts(read_files(spark, [str(p) for p in paths])).collect()}
    assert found == {k: reason for k, (_, reason) in cases.items()}


def test_scope_is_inclusive_and_open_ended(spark):
    days = spark.createDataFrame([(f"2026092{k}",) for k in range(5)], "day string")
    assert scope.select_days(days, "20260921", "20260923").count() == 3
    assert scope.select_days(days, None, "20260921").count() == 2
    assert scope.select_days(days, "20260930", None).count() == 0


def test_listing_classifies_and_explains(spark, tmp_path):
    folder = tmp_path / "install/datadir/SH/86400"
    for name in ("600000.DAT", "600001.dat", "000001.DAT", "987654.DAT", "odd.DAT", "600002.DAT"):
        write_dat(folder / name, row())
    (folder / "600003.DAT").symlink_to(folder / "600000.DAT")
    request = Request(tmp_path / "install/datadir", tmp_path / "out", periods=("1d",), codes=("600000.SH", "600001.sh", "000001.SH", "600003.SH"))
    sources, issues = scan_sources(spark, request)
    assert [(s["code"], s["kind"]) for s in sources] == [("000001.SH", "index"), ("600000.SH", "stock"), ("600001.SH", "stock")]
    assert sorted(i["reason"] for i in issues) == ["code-filter", "inaccessible-file", "missing-period-directory", "nonstandard-name", "unclassified"]
    with pytest.raises(BarError, match="overlaps"):
        scan_sources(spark, Request(tmp_path / "install/datadir", tmp_path / "install/out"))


@pytest.mark.parametrize("text,iso", [("20260922", "2026-09-22"), ("2026-09-22", "2026-09-22"), ("2026-9-22", "2026-09-22"), (None, None)])
def test_dates(text, iso):
    assert iso_date(text) == iso


@pytest.mark.parametrize("kind,text", [("start", "2026-9-1"), ("end", "19691231"), ("start", "x")])
def test_bad_dates(tmp_path, kind, text):
    with pytest.raises(BarError, match="invalid-date"):
        Request(tmp_path, tmp_path, **{kind: text})


def test_bad_requests(tmp_path):
    for kind, bad in (("periods", ("5m",)), ("mode", "other")):
        with pytest.raises(BarError, match="invalid"):
            Request(tmp_path, tmp_path, **{kind: bad})
    with pytest.raises(BarError, match="invalid-date-range"):
        Request(tmp_path, tmp_path, start="20260923", end="20260922")


def test_settings_round_trip_and_keep_the_old_file(tmp_path):
    path = tmp_path / "s.json"
    save_settings(path, source="in", output=str(tmp_path / "out"), period="1d")
    assert load_settings(path) == Settings(str(tmp_path / "in"), str(tmp_path / "out"), "1d")
    before = path.read_text()
    with pytest.raises(BarError):
        save_settings(path, source="", output="x", period="1d")
    assert path.read_text() == before
    for bad in ("{", "[]", '{"source": 1}', '{"period": "5m"}', '{"other": "x"}'):
        path.write_text(bad)
        with pytest.raises(BarError, match="invalid-config"):
            load_settings(path)
    assert load_settings(tmp_path / "none.json").periods == ("1d", "1m")
    with pytest.raises(BarError, match="config-not-found"):
        load_settings(tmp_path / "none.json", required=True)


@pytest.mark.parametrize("change", [
    {"timestamp": 2**63}, {"timestamp": 10**400}, {"timestamp": True}, {"fields": {}}, {"fields": {"close": 10**400}}, {"fields": {"volume": 1.0}}, {"fields": {"close": float("inf")}},
    {"fields": {"code": 1}}, {"fields": {"other": 1}}, {"code": "600000.XX"}, {"period": "5m"},
])
def test_evidence_is_strict(tmp_path, change):
    item = {"code": "600000.SH", "period": "1d", "timestamp": 2**63 - 1, "fields": {"close": 7.25}}
    source = {"description": "made up", "sha256": "0" * 64, "provenance": "independent"}
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"version": 1, "source": source, "comparisons": [item]}))
    assert evidence.load_evidence(path)[0]["comparisons"] == [item]
    path.write_text(json.dumps({"version": 1, "source": source, "comparisons": [item | change]}))
    with pytest.raises(BarError, match="invalid-evidence"):
        evidence.load_evidence(path)


def test_output_guards(tmp_path):
    from barloom.state import output_lock, safe_path

    with output_lock(tmp_path / "o"), pytest.raises(BarError, match="output-locked"), output_lock(tmp_path / "o"):
        pass
    with pytest.raises(BarError, match="escape"):
        safe_path(tmp_path, "../x")
    (tmp_path / "link").symlink_to(tmp_path)
    with pytest.raises(BarError, match="output-link"):
        safe_path(tmp_path, "link/x")


def test_report_text_and_progress():
    from barloom.plans.engine import COUNTERS, unverified
    from barloom.report import format_report
    from barloom.streaming.progress import RunLog

    report = {
        "action": "convert", "status": "partial", "run_id": "r", "elapsed_seconds": 1.0, "timings": {"scan": 0.5}, "issue_counts": {}, "issues": [], "counts": dict.fromkeys(COUNTERS, 0),
        "scope": {"source": "s", "output": "o", "periods": ["1d"], "codes": [], "start": None, "end": None, "mode": "full"}, "verification": unverified(), "paths": {"report": "p"},
    }
    events = []
    log = RunLog(report, events.append)
    log.issue("partition-unpublishable", "data/x", blocking_codes=["600000.SH"])
    log.issues([{"category": "excluded", "reason": "unclassified"}])
    text = format_report(report)
    told = lambda r: {k.strip(): v.strip() for k, _, v in (line[2:].partition("  ") for line in format_report(r).splitlines() if line.startswith("  "))}
    assert "blocked by: 600000.SH" in text and (told(report)["errors"], told(report)["files left out"], told(report)["status"]) == ("1", "1", "partial")
    old = report | {"issue_counts": None, "issues": report["issues"] * 70}
    assert (told(old)["errors"], told(old)["mostly for"]) == ("70", "unclassified (70)") and "40 more in the JSON report" in format_report(old)
    days = {"category": "warning", "reason": "invalid-ohlc", "days": ["20260901", "20260902", "20260903"]}
    assert "days: 20260901, 20260902 and others, 3 in all" in format_report(report | {"issues": [days]})
    assert [e["event"] for e in events] == ["issue"] and report["issue_counts"] == {"error": 1, "excluded": 1}


def test_flags_go_before_settings_and_defaults(tmp_path):
    from barloom.cli import parser, resolve

    settings = tmp_path / "s.json"
    save_settings(settings, source=str(tmp_path / "in"), output=str(tmp_path / "out"), period="1m")
    parse = lambda *a: resolve(vars(parser().parse_args(["convert", "--config", str(settings), *a])))
    assert parse() == Request(tmp_path / "in", tmp_path / "out", ("1m",))
    other = parse("--source", str(tmp_path / "x"), "--period", "both", "--code", "600000.sh", "--mode", "range", "--start", "20260922", "--end", "2026-09-23")
    assert (other.source.name, other.periods, other.codes, other.bounds) == ("x", ("1d", "1m"), ("600000.SH",), ("20260922", "20260923"))
    with pytest.raises(BarError, match="range requires"):
        parse("--mode", "range")
    with pytest.raises(BarError, match="config-required"):
        resolve({"action": "scan", "output": tmp_path})


def test_exit_codes_and_what_is_said():
    from barloom.report import outcome

    report = {"action": "convert", "status": "partial", "paths": {"report": "r.json"}, "issues": [{"category": "error", "reason": "source-missing", "path": "a"}, {"category": "warning", "reason": "w"}]}
    assert outcome(report) == (["convert: partial", "r.json"], ["source-missing: a"], 1)
    assert outcome(report | {"status": "complete", "issues": []}).code == 0
    assert outcome(report | {"status": "failed", "paths": {"report": None}}) == (["convert: failed"], ["source-missing: a"], 1)


def test_commands_exit_by_status(spark, tmp_path, capsys, monkeypatch):
    from barloom import cli

    monkeypatch.chdir(tmp_path)
    write_dat(tmp_path / "install/datadir/SH/86400/600000.DAT", row())
    flags = ["--source", str(tmp_path / "install/datadir"), "--output", str(tmp_path / "out"), "--period", "1d"]
    assert cli.main(["scan", *flags]) == 0 and capsys.readouterr().out.startswith("scan: complete\n")
    assert cli.main(["scan", *flags[:2], "--output", str(tmp_path / "install/out")]) == 1
    assert "output-path-overlaps-source-installation" in capsys.readouterr().err
    with pytest.raises(SystemExit) as refused:
        cli.main(["convert", "--mode", "range", "--start", "20260922", *flags])
    assert refused.value.code == 2


def test_queries_and_sql_go_together():
    from barloom.plans.queries import QUERIES, SQL

    assert set(SQL) == set(QUERIES)
