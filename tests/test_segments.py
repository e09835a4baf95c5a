"""Ranges of files: any cut gives what the whole file gives."""

import hashlib
import random
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.operators import segments
from barloom.sources import records
from barloom.sources.records import Range, Wanted, cut, file_hashes, file_verdicts, read_files, read_range
from tests.conftest import HEADER, row, write_dat

DAY = 86400
WANTED = Wanted("20260923", "20260925")


def sample(rng, n):
    """Records with now and then a fault; some samples are in order, some not."""
    out, second = [], 0
    for _ in range(n):
        second += rng.choice([60, 3600, DAY, 0 if rng.random() < 0.02 else 60])
        change = rng.choice([{}] * 12 + [{"w2": 7100}, {"w4": 0}, {"w14": 1}, {"w8": 1, "w9": 2**21}])
        out.append(row(second, **(change if rng.random() < 0.1 else {})))
    return np.array(out, "<u4")


def whole_file(words):
    """The verdict by plain Python, from all records at once."""
    seconds = words[:, 0].astype(int).tolist()
    day = lambda s: str(np.datetime64(s + 8 * 3600, "s"))[:10].replace("-", "")
    bad = [0 in r[1:5] or r[2] < max(r[1], r[3], r[4]) or r[3] > min(r[1], r[2], r[4]) for r in words.astype(int).tolist()]
    inside = [WANTED.start <= day(s) <= WANTED.end for s in seconds]
    failure = next((reason for reason, failed in (
        ("invalid-time-order", 0 in seconds or any(b <= a for a, b in zip(seconds, seconds[1:]))), ("invalid-ohlc", any(b and i for b, i in zip(bad, inside))),
        ("unknown-status", words[:, 14].any()), ("amount-not-exactly-representable", any(int(h) << 32 | int(low) > 2**53 for low, h in words[:, 8:10])),
    ) if failed), None)
    sides = {}
    for k, (b, i) in enumerate(zip(bad, inside)):
        if b:
            own = sides.setdefault(i, [0, set(), []])
            own[0] += 1
            own[1].add(day(seconds[k]))
            own[2].append(k)
    days = {}
    for s in seconds:
        days[day(s)] = days.get(day(s), 0) + 1
    return failure, {i: (n, sorted(d), at[:10]) for i, (n, d, at) in sides.items()}, days


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.lists(st.integers(1, 59), max_size=6), st.randoms())
def test_any_cut_and_any_grouping_give_the_whole(seed, n, cuts, order):
    words = sample(random.Random(seed), n)
    part = Range("f", 0, n, 8 + 64 * n, None)
    edges = [0, *sorted({c for c in cuts if c < n}), n]
    pieces = [records.summarise(part, a, words[a:b], WANTED, hashlib.sha256(bytes([k])).digest())[0] for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    left = reduce(segments.join, pieces)
    right = reduce(lambda acc, s: segments.join(s, acc), reversed(pieces))
    middle = order.randrange(len(pieces)) or 1
    grouped = segments.join(segments.join_all(pieces[:middle]), segments.join_all(pieces[middle:])) if len(pieces) > 1 else left
    shuffled = list(pieces)
    order.shuffle(shuffled)
    assert left == right == grouped == segments.join_all(shuffled)
    assert len(segments._adjacent(shuffled)) == 1
    failure, sides, days = whole_file(words)
    found = segments.verdict(left)
    assert found["failure"] == failure and {d["day"]: d["rows"] for d in found["inventory"]} == days and found["n"] == n
    assert {b["blocking"]: (b["count"], b["days"], [r["record"] for r in b["rows"]]) for b in found["bad"]} == sides


def test_segments_that_are_not_neighbours_do_not_join():
    words = sample(random.Random(1), 9)
    part = Range("f", 0, 9, 8 + 64 * 9, None)
    a, b = (records.summarise(part, k, words[k : k + 3], WANTED, b"x" * 32)[0] for k in (0, 6))
    with pytest.raises(ValueError, match="not adjacent"):
        segments.join(a, b)
    with pytest.raises(ValueError, match="not adjacent"):
        segments.join(a, {**b, "path": "g", "start": 3})


@pytest.fixture
def long_file(tmp_path):
    """Three leaves and a bit, one minute a record, with a bad price in the last leaf."""
    n = 3 * segments.LEAF + 100
    words = np.tile(np.array(row(), "<u4"), (n, 1))
    words[:, 0] += np.arange(n, dtype="<u4") * 60
    words[n - 50, 2] = 7100
    path = tmp_path / "600000.DAT"
    path.write_bytes(HEADER + words.tobytes())
    return path, words


def test_many_tasks_read_what_one_reads(spark, long_file):
    path, words = long_file
    wanted = Wanted("20260924", "20260926")
    one, many = (read_files(spark, [str(path)], wanted, split).cache() for split in (records.SPLIT, segments.LEAF))
    assert (one.where("rec IS NULL").count(), many.where("rec IS NULL").count()) == (1, 4)
    a, b = (file_verdicts(rows).collect() for rows in (one, many))
    assert a == b and a[0]["n"] == len(words) and a[0]["failure"] is None
    assert [(x["blocking"], x["count"], x["rows"][0]["record"]) for x in a[0]["bad"]] == [(False, 1, len(words) - 50)]
    pick = ["rec", "day", "raw", *(f"w{k}" for k in records.WORDS)]
    assert one.where("rec IS NOT NULL").select(pick).exceptAll(many.where("rec IS NOT NULL").select(pick)).count() == 0
    assert many.where("rec IS NOT NULL").count() == 3 * 1440
    raw = path.read_bytes()
    leaves = [raw[: 8 + 64 * segments.LEAF], *(raw[8 + 64 * segments.LEAF * k : 8 + 64 * segments.LEAF * (k + 1)] for k in (1, 2, 3))]
    assert a[0]["sha256"] == hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in leaves)).hexdigest()
    signature = records.stat_signature(path)
    assert file_hashes(spark, [(str(path), signature)], segments.LEAF) == {str(path): a[0]["sha256"]}
    assert file_hashes(spark, [(str(path), {**signature, "inode": 1})]) == {str(path): None}


def test_short_file_has_its_plain_hash(spark, tmp_path):
    path = write_dat(tmp_path / "600000.DAT", row())
    assert file_verdicts(read_files(spark, [str(path)])).first()["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()


def test_ranges_cover_a_file_once():
    for length in (0, 5, 8, 9, 72, 8 + 64 * segments.LEAF, 9 + 64 * segments.LEAF, 8 + 64 * (5 * segments.LEAF + 1)):
        parts = cut("f", length, None, segments.LEAF)
        assert [p.start for p in parts] == [0, *(p.start + p.n for p in parts[:-1])]
        assert 8 + 64 * sum(p.n for p in parts) >= length > 8 + 64 * (sum(p.n for p in parts) - 1) or length <= 8
    with pytest.raises(ValueError, match="whole leaves"):
        cut("f", 1000, None, 100)


def test_a_file_that_moves_is_read_again_unless_its_identity_is_demanded(tmp_path, monkeypatch):
    path = write_dat(tmp_path / "600000.DAT", row(), row(60))
    signature, looks = records.stat_signature(path), []
    real = records.signature_of

    def moving(found):
        looks.append(1)
        return {**real(found), "mtime_ns": len(looks)} if len(looks) <= moves else real(found)

    monkeypatch.setattr(records, "signature_of", moving)
    for moves, failed in ((2, False), (100, True)):
        looks.clear()
        found = list(read_range(Range(str(path), 0, 2, 136, None), Wanted()))
        assert ("source-changed" in (found[-1]["failure"] or "")) == failed and (failed or found[0].num_rows == 2)
    moves = 1
    looks.clear()
    assert "source-changed" in list(read_range(Range(str(path), 0, 2, 136, signature), Wanted()))[-1]["failure"]
    moves = 0
    assert list(read_range(Range(str(path), 0, 2, 136, signature), Wanted()))[-1]["failure"] is None
    path.rename(tmp_path / "kept")
    path.symlink_to(tmp_path / "kept")
    assert "source-link" in list(read_range(Range(str(path), 0, 2, 136, None), Wanted()))[-1]["failure"]


def test_data_source_pushes_days_down(spark, long_file):
    path, words = long_file
    spark.dataSource.register(records.BarRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        reader = spark.read.format("bar_records").option("split", segments.LEAF)
        whole = reader.load(str(path))
        assert whole.count() == len(words) and whole.rdd.getNumPartitions() == 4
        for ordered in ("false", "true"):
            some = reader.option("ordered", ordered).load(str(path)).where("day >= '20260924' AND day < '20260926' AND w6 = 1234")
            plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
            assert "GreaterThanOrEqual(day,20260924)" in plan[plan.index("PushedFilters") :][:200], plan
            assert {(r["day"], r["n"]) for r in some.groupBy("day").count().withColumnRenamed("count", "n").collect()} == {("20260924", 1440), ("20260925", 1440)}
        one = reader.option("ordered", "true").load(str(path)).where("day = '20261001'")
        assert one.rdd.getNumPartitions() == 1 and one.count() == 1440
        assert reader.load(str(path)).where("day > 'x'").count() == 0 and reader.load(str(path)).where("day <= '20260922'").count() == 780
        assert reader.load(str(path.parent)).count() == len(words)
        path.write_bytes(b"bad")
        with pytest.raises(Exception, match="unknown-header"):
            reader.load(str(path)).count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
