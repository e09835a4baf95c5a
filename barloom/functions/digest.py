"""Canonical content digests of bar groups: SHA-256 over columns of sorted rows.

Rows are dealt by group and sorted by Spark; tasks take the sorted Arrow batches as they come, hash every group
that lies in a batch from slices of the batch's own buffers, and carry over only the rows of a group that is not whole yet.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.errors import BarError
from barloom.schema import BAR_COLUMNS, BAR_FIELDS, DIGEST_TAG

_ORDER = ("code", "timestamp", *(c for c in BAR_COLUMNS if c not in ("code", "timestamp")))
_TEXTS = tuple(name for name, kind in BAR_FIELDS if kind.typeName() == "string")
_TAG = (DIGEST_TAG + chr(0)).encode()
#: Digests of one Arrow batch of output.
_FLUSH = 4096


def check_digestible(columns) -> None:
    """The bar columns, whatever their order; BarError otherwise."""
    if set(columns) != set(BAR_COLUMNS):
        raise BarError("digest-schema-mismatch")


def _digests(batch: pa.RecordBatch):
    """From the first row and the end of a group in the batch to its digest."""
    parts = []
    for name, _ in BAR_FIELDS:
        column = batch.column(name)
        if column.null_count:
            raise ValueError("digest-null-field")
        parts.append(_text_buffers(column.cast(pa.string())) if name in _TEXTS else (None, memoryview(np.ascontiguousarray(column.to_numpy()).view(np.uint8))))

    def digest(start: int, end: int) -> str:
        out = hashlib.sha256(_TAG + struct.pack("<Q", end - start))
        for offsets, data in parts:
            if offsets is None:
                out.update(data[8 * start : 8 * end])
            else:
                out.update((offsets[start : end + 1] - offsets[start]).astype("<i4").tobytes())
                out.update(data[offsets[start] : offsets[end]])
        return out.hexdigest()

    return digest


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4), memoryview(data or b"")


def _joined_hashes(batch: pa.RecordBatch):
    """From the first row and the end of a group to the SHA-256 of its raw bytes."""
    offsets, data = _text_buffers(batch.column("raw").cast(pa.binary()))
    return lambda start, end: hashlib.sha256(data[offsets[start] : offsets[end]]).hexdigest()


def _counts(batch: pa.RecordBatch):
    return lambda start, end: end - start


def _audits(batch: pa.RecordBatch):
    """From the first row and the end of a group to its audit words; null where they are not kept."""
    column = batch.column("audit")
    words, kept = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return lambda start, end: words[start:end].tolist() if kept[start:end].all() else None


_KINDS = {_counts: (T.LongType(), pa.int64()), _audits: (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}
_TEXT = (T.StringType(), pa.string())


def _edges(batch: pa.RecordBatch, keys: tuple[str, ...]) -> list[int]:
    """Rows at which another group begins, after the first row."""
    changed = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        column = batch.column(k)
        changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return (np.flatnonzero(changed) + 1).tolist()


def _same_group(a: pa.RecordBatch, b: pa.RecordBatch, keys: tuple[str, ...]) -> bool:
    return all(a.column(k)[0] == b.column(k)[0] for k in keys)


def _of_groups(dealt: DataFrame, keys: tuple[str, ...], found: dict) -> DataFrame:
    """keys and one value a group for each name in found, whose makers take a batch; rows are dealt by the keys and sorted by them first."""
    kinds, names = [_KINDS.get(maker, _TEXT) for maker in found.values()], [*keys, *found]

    def made(batch: pa.RecordBatch, firsts: list[int], ends: list[int]) -> pa.RecordBatch:
        values = [[of(a, b) for a, b in zip(firsts, ends)] for of in (maker(batch) for maker in found.values())]
        at = pa.array(firsts, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array(v, k) for v, (_, k) in zip(values, kinds))], names=names)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return made(batch, [0], [batch.num_rows])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = _edges(batch, keys)
            if held and _same_group(held[0], batch, keys):
                held.append(batch.slice(0, edges[0] if edges else None))
                if not edges:
                    continue
            else:
                edges = [0, *edges]
            if held:
                yield whole(held)
            # Groups from edge to edge are whole; the last one may go on.
            for k in range(0, len(edges) - 1, _FLUSH):
                part = edges[k : k + _FLUSH + 1]
                yield made(batch, part[:-1], part[1:])
            held = [batch.slice(edges[-1])]
        if held:
            yield whole(held)

    return dealt.mapInArrow(run, T.StructType([dealt.schema[k] for k in keys] + [T.StructField(n, k) for n, (k, _) in zip(found, kinds)]))


def group_digests(bars: DataFrame, *keys: str, raw: bool = False) -> DataFrame:
    """keys, digest, rows: of each group of bars. If asked also raw_hash of the raw bytes and audit, the list of the audit words, in time order.

    Keys are not null; a null in any bar column raises digest-null-field.
    """
    dealt = bars.select(*dict.fromkeys((*keys, *BAR_COLUMNS, *(("raw", "audit") if raw else ())))).repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *(c for c in _ORDER if c not in keys))
    return _of_groups(dealt, keys, {"digest": _digests, "rows": _counts, **({"raw_hash": _joined_hashes, "audit": _audits} if raw else {})})


def group_hashes(records: DataFrame, order: str, *keys: str) -> DataFrame:
    """keys, raw_hash: SHA-256 of the raw bytes of each group in the given order."""
    dealt = records.select(*keys, order, "raw").repartition(*keys).sortWithinPartitions(*keys, order)
    return _of_groups(dealt, keys, {"raw_hash": _joined_hashes})


def merged_digest(parts: DataFrame, *keys: str) -> DataFrame:
    """keys, digest: one digest of the (code, day, digest) rows of each group; its size follows days, not bars."""
    line = F.concat_ws(":", "code", "day", "digest")
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
