"""External evidence: strict parsing and comparison with bars."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.errors import BarError
from barloom.schema import BAR_FIELDS
from barloom.sources.local import local_frame

_KINDS = {name: kind.typeName() for name, kind in BAR_FIELDS}
EXPECTED = "item long, code string, period string, timestamp long, field string, text string, whole long, number double"

_LARGEST = sys.float_info.max
#: What a value of each kind of bar column may be.
_VALUES = {
    "string": lambda v: isinstance(v, str),
    "long": lambda v: type(v) is int,
    "double": lambda v: type(v) in (int, float) and -_LARGEST <= v <= _LARGEST,
}
_text = lambda pattern: lambda v: isinstance(v, str) and bool(re.fullmatch(pattern, v, re.S))
_known_fields = lambda v: isinstance(v, dict) and v and all(_VALUES[_KINDS[k]](x) if k in _KINDS else False for k, x in v.items())

#: The shape of an evidence file: an object's keys are all needed and others are allowed, a list has one shape for all
#: of its items and is not empty, and a function tells whether a value will do.
SHAPE = {
    "version": lambda v: v == 1,
    "source": {"description": _text(r".*\S.*"), "sha256": _text("[0-9a-fA-F]{64}"), "provenance": _text("same-source|independent")},
    "comparisons": [{"code": _text(r"\d{6}\.(SH|SZ)"), "period": _text("1d|1m"), "timestamp": lambda v: type(v) is int and 0 < v < 2**63, "fields": _known_fields}],
}


def misfits(value, shape, where: str = "evidence"):
    """Places in which a value departs from a shape."""
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            yield where
            return
        for key, inner in shape.items():
            yield from misfits(value[key], inner, f"{where}.{key}") if key in value else (f"{where}.{key}",)
    elif isinstance(shape, list):
        if not isinstance(value, list) or not value:
            yield where
            return
        for k, item in enumerate(value):
            yield from misfits(item, shape[0], f"{where}[{k}]")
    elif not shape(value):
        yield where


def load_evidence(path: Path) -> tuple[dict, str]:
    """The payload and the digest of its file; BarError invalid-evidence for anything that is not exactly as expected."""
    try:
        raw = Path(path).read_bytes()
        payload = json.loads(raw)
    except (OSError, ValueError) as exc:
        raise BarError(f"invalid-evidence: {exc}") from exc
    wrong = next(misfits(payload, SHAPE), None)
    if wrong:
        raise BarError(f"invalid-evidence: {wrong}")
    return payload, hashlib.sha256(raw).hexdigest()


def expected_fields(spark: SparkSession, payload: dict) -> DataFrame:
    """One row for every expected field value."""
    rows = []
    for i, item in enumerate(payload["comparisons"]):
        for name, value in item["fields"].items():
            kind = _KINDS[name]
            whole = value if kind == "long" and abs(value) < 2**63 else None
            number = float(value) if kind == "double" else None
            rows.append((i, item["code"], item["period"], item["timestamp"], name, value if kind == "string" else None, whole, number))
    return local_frame(spark, rows, EXPECTED)


def match_evidence(expected: DataFrame, bars: DataFrame) -> DataFrame:
    """item, matched: whether a bar of the code, period and timestamp has all expected values."""
    keyed = expected.join(bars, ["code", "period", "timestamp"], "left")
    actual = F.lit(False)
    for name, kind in BAR_FIELDS:
        side = {"string": "text", "long": "whole", "double": "number"}[kind.typeName()]
        actual = F.when(F.col("field") == name, F.coalesce(F.col(name) == F.col(side), F.lit(False))).otherwise(actual)
    return keyed.groupBy("item").agg(F.bool_and(actual).alias("matched"))


def match_values(wanted: DataFrame, actual: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """keys, matched: left join on the keys, then equality of all fields; an absent row does not match."""
    right = actual.select(*keys, *[F.col(f).alias(f"_actual_{f}") for f in fields])
    equal = F.lit(True)
    for f in fields:
        equal = equal & (F.col(f) == F.col(f"_actual_{f}"))
    return wanted.join(right, list(keys), "left").select(*keys, F.coalesce(equal, F.lit(False)).alias("matched"))
