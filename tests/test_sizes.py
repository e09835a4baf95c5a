"""Queries of the driver's tables with values that only larger copies or odd inputs hold, against their SQL."""

import datetime as dt
import hashlib
import struct

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barloom.plans import queries
from barloom.sources import records


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL over the tables."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, folder / f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found, wanted = queries.QUERIES[name](spark, str(folder)), con.execute(queries.SQL[name])
    assert found.columns == [c[0] for c in wanted.description]
    return sorted(map(tuple, found.collect()), key=repr), sorted(wanted.fetchall(), key=repr)


def test_words_of_any_long(spark, tmp_path):
    keys = [0, 1, 4294967, 4294968, 8_999_999, 9 * 10**15, -1, -9 * 10**15, None]
    lines = pa.table({"l_orderkey": pa.array(keys, pa.int64()), "l_linenumber": pa.array([1, 7, 295, 1, 7, 7, 1, 3, 1], pa.int32())})
    found, wanted = both(spark, tmp_path, "le_word_decode", lineitem=lines)
    assert found == wanted and len(found) == 9


def events(*rows):
    """A table of events from (event_id, ts, value), of one user."""
    ids, times, values = zip(*rows)
    columns = {"event_id": pa.array(ids, pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "user_id": pa.array([0] * len(rows), pa.int64())}
    return pa.table({**columns, "event_type": ["click"] * len(rows), "value": pa.array(values, pa.float64())})


#: A high below zero (event 97, value under 1), prices of more than 32 bits, and seconds before 1970.
ODD = [(96, 0, 50.0), (97, 1, 0.5), (100, 2, 5_000_000.25), (194, 3, 0.0), (195, 4, 4_294_967.296), (196, 5, 3.0), (198, 40, 9.0), (291, 41, 0.99), (292, 42, 1.0)]


@pytest.mark.parametrize("start", [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 3), dt.datetime(1969, 12, 30, 1, 0, 0, 500_000)])
@pytest.mark.parametrize("name", ["segment_bad_rows", "segment_summary", "segment_inventory"])
def test_segments_hold_any_price(spark, tmp_path, name, start):
    rows = events(*((i, start + dt.timedelta(hours=h), v) for i, h, v in ODD))
    found, wanted = both(spark, tmp_path, name, events=rows)
    assert found == wanted and found
    if name == "segment_bad_rows":
        assert any(high < 0 for *_, high, _ in found)


def test_words_of_a_file_keep_the_hash_of_its_bytes(spark):
    """And words that differ by 2^32 are not taken for each other."""
    def leaf(w2):
        row = {"path": "f", "rec": 0, **{f"w{k}": 0 for k in records.WORDS}, "w2": w2}
        schema = "path string, rec long, " + ", ".join(f"w{k} long" for k in records.WORDS)
        return bytes(records.range_segments(spark.createDataFrame([row], schema), 7).first()["leaves"])

    assert leaf(7100) == hashlib.sha256(struct.pack("<16I", 0, 0, 7100, *[0] * 13)).digest()
    assert len({leaf(7100), leaf(7100 + 2**32), leaf(7100 - 2**32)}) == 3
