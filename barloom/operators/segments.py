"""Summaries of runs of records that join to the summary of the whole file, wherever it was cut.

A segment tells of consecutive records of one file: where they begin and end in time, whether they are
in order, what is wrong with them, their days, and the hashes of their leaves. Two adjacent segments join
to one; joining is associative, so segments can be made and joined on any machine and in any grouping, as long as
they stay in order. The border of two segments is checked when they are joined.

A file's hash is that of the hashes of its leaves, LEAF records each; of a file with one leaf it is that leaf's,
which is the SHA-256 of the file's bytes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

#: Records of a leaf (1 MiB); files are cut between leaves.
LEAF = 16_384
#: Bad rows kept of each side of the scope.
SHOWN = 10

_ROW = pa.struct([("record", pa.int64()), ("day", pa.string()), ("datetime", pa.string()), *((p, pa.float64()) for p in ("open", "high", "low", "close"))])
SEGMENT = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("length", pa.int64()), ("failure", pa.string()),
    ("first", pa.int64()), ("last", pa.int64()), ("disordered", pa.bool_()), ("unknown_status", pa.bool_()), ("inexact", pa.bool_()),
    ("bad", pa.list_(pa.struct([("blocking", pa.bool_()), ("count", pa.int64()), ("days", pa.list_(pa.string())), ("rows", pa.list_(_ROW))]))),
    ("days", pa.list_(pa.struct([("day", pa.string()), ("rows", pa.int64())]))), ("leaves", pa.binary()),
])


def _joined_bad(a: list[dict], b: list[dict]) -> list[dict]:
    by: dict[bool, dict] = {}
    for side in (*a, *b):
        own = by.get(side["blocking"])
        by[side["blocking"]] = side if own is None else {
            "blocking": side["blocking"], "count": own["count"] + side["count"], "days": sorted({*own["days"], *side["days"]}), "rows": [*own["rows"], *side["rows"]][:SHOWN]
        }
    return [by[k] for k in sorted(by)]


def _joined_days(a: list[dict], b: list[dict]) -> list[dict]:
    """Days as they come; the day of the border may be in both. A day that comes again later is found by its name."""
    if a and b and a[-1]["day"] == b[0]["day"]:
        a, b = [*a[:-1], {"day": b[0]["day"], "rows": a[-1]["rows"] + b[0]["rows"]}], b[1:]
    return [*a, *b]


def join(a: dict, b: dict) -> dict:
    """The segment of both; b must begin where a ends."""
    if (a["path"], a["start"] + a["n"]) != (b["path"], b["start"]):
        raise ValueError(f"segments of {a['path']} and {b['path']} are not adjacent: {a['start']} + {a['n']}, {b['start']}")
    apart = a["n"] > 0 and b["n"] > 0
    return {
        **{k: a[k] for k in ("path", "start", "length")}, "n": a["n"] + b["n"], "failure": a["failure"] or b["failure"],
        "first": a["first"] if a["n"] else b["first"], "last": b["last"] if b["n"] else a["last"],
        "disordered": a["disordered"] or b["disordered"] or (apart and b["first"] <= a["last"]),
        **{k: a[k] or b[k] for k in ("unknown_status", "inexact")},
        "bad": _joined_bad(a["bad"], b["bad"]), "days": _joined_days(a["days"], b["days"]), "leaves": a["leaves"] + b["leaves"],
    }


def join_all(segments) -> dict:
    """Of segments in any order."""
    return reduce(join, sorted(segments, key=lambda s: s["start"]))


def inventory(segment: dict) -> dict[str, int]:
    """Records of each day; the days of a file out of order may come several times."""
    out: dict[str, int] = {}
    for d in segment["days"]:
        out[d["day"]] = out.get(d["day"], 0) + d["rows"]
    return out


def file_hash(leaves: bytes) -> str:
    return leaves.hex() if len(leaves) == 32 else hashlib.sha256(leaves).hexdigest()


def failure_of(segment: dict) -> str | None:
    """The first check, in their fixed order, that the whole does not pass."""
    checks = (
        (segment["failure"], bool(segment["failure"])), ("invalid-time-order", segment["disordered"]), ("invalid-ohlc", any(b["blocking"] for b in segment["bad"])),
        ("unknown-status", segment["unknown_status"]), ("amount-not-exactly-representable", segment["inexact"]),
    )
    return next((reason for reason, failed in checks if failed), None)


_VERDICT = pa.schema([
    *(SEGMENT.field(k) for k in ("path", "n", "length", "failure", "bad")), ("sha256", pa.string()), ("inventory", SEGMENT.field("days").type),
])
VERDICTS = from_arrow_schema(_VERDICT)


def verdict(segment: dict) -> dict:
    """What the whole of a file is: its first failed check, hash, days and bad prices."""
    days = [{"day": d, "rows": n} for d, n in sorted(inventory(segment).items())]
    # What is no sound file of records has none.
    return {**{k: segment[k] for k in ("path", "length", "bad")}, "n": None if segment["failure"] else segment["n"], "failure": failure_of(segment), "sha256": file_hash(segment["leaves"]), "inventory": days}


#: Segments of one file that are held before they are joined.
_HELD = 256


def verdicts(segments: DataFrame) -> DataFrame:
    """One row a file, of VERDICTS, from its segments in any order; files are dealt by path and each keeps one joined run at a time where segments come in order."""

    def run(batches):
        held: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = held.setdefault(row["path"], [])
                own.append(row)
                if len(own) % _HELD == 0:
                    held[row["path"]] = _adjacent(own)
        for path, own in held.items():
            yield pa.RecordBatch.from_pylist([verdict(join_all(own))], schema=_VERDICT)

    return segments.select(*SEGMENT.names).repartition("path").mapInArrow(run, VERDICTS)


def _adjacent(segments: list[dict]) -> list[dict]:
    """Neighbours joined; gaps are left for segments that are still to come."""
    out: list[dict] = []
    for s in sorted(segments, key=lambda s: s["start"]):
        if out and out[-1]["start"] + out[-1]["n"] == s["start"]:
            out[-1] = join(out[-1], s)
        else:
            out.append(s)
    return out
