"""Op 1: media columns as content-defined chunks.

A text becomes 8-bit mono PCM in a RIFF/WAVE container. The container bytes are
cut where a rolling gear hash meets a mask, chunks are deduplicated by digest
with Spark joins, and ordered chunk lists rebuild every distinct medium, which
is verified by its digest before features are computed from the bytes read back.

The texts are read twice: for ids and chunk lists, then for the chunks. A chunk that
is in very many media, or a medium of very many rows, is broadcast, never one task's.

Defined results: a null or empty text has an empty payload padded to one block;
equal texts share one medium and so all values; repeated rows and repeated or
null ids each keep their own output row; an empty table gives no rows; other input
columns are ignored. A text is one medium however long: it is chunked and read back
in one task, in memory of a few times its bytes.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import shingles
from barloom.llm.common import HOT_KEYS, cut_lineage, join_by_weight, read_table

BLOCK = 576
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 1024, 12, 16384
#: Digests that one task remembers so as not to emit a chunk twice; only shuffle volume depends on it.
REMEMBERED = 50_000

def _gear_table() -> np.ndarray:
    """256 pseudo-random words from a splitmix sequence."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear_table()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of BLOCK, and the unpadded length."""
    raw = (text or "").encode("utf-8")
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return raw + b"\xff" * (size - len(raw)), len(raw)


def to_media(payload: bytes) -> bytes:
    """8-bit unsigned mono PCM at 8 kHz; the sample bytes are the payload."""
    return (
        b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt "
        + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    )


def from_media(media: bytes) -> bytes:
    """Sample bytes of a container written by to_media; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a PCM container of this store")
    (size,) = struct.unpack_from("<I", media, 40)
    if len(media) != 44 + size:
        raise ValueError("container length differs from its header")
    return media[44:]


def cut_points(data: bytes) -> list[int]:
    """Chunk ends. The gear hash at a byte covers the 32 bytes up to it, so cuts follow content."""
    if len(data) <= MIN_CHUNK:
        return [len(data)]
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    cuts, start, at = [], 0, 0
    while len(data) - start > MIN_CHUNK:
        at = int(np.searchsorted(marks, start + MIN_CHUNK, side="left"))
        end = int(marks[at]) if at < len(marks) else len(data)
        end = min(end, start + MAX_CHUNK, len(data))
        cuts.append(end)
        start = end
    if start < len(data):
        cuts.append(len(data))
    return cuts


class _Seen:
    """A bounded set with least-recently-used eviction."""

    def __init__(self, size: int):
        self.size, self.keys = size, OrderedDict()

    def add(self, key: bytes) -> bool:
        """True if the key is new."""
        if key in self.keys:
            self.keys.move_to_end(key)
            return False
        self.keys[key] = None
        if len(self.keys) > self.size:
            self.keys.popitem(last=False)
        return True


_ROWS = pa.schema([("doc_id", pa.int64()), ("media_id", pa.binary()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.binary()))])
_BLOBS = pa.schema([("digest", pa.binary()), ("blob", pa.binary())])
#: Bytes of blobs in one Arrow batch of output.
_FLUSH = 4 << 20


def _chunks(media: bytes):
    start = 0
    for end in cut_points(media):
        yield media[start:end]
        start = end


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _media_rows(batches):
    seen = _Seen(REMEMBERED)
    for batch in shingles.small_batches(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            payload, n = payload_of(text)
            media = to_media(payload)
            media_id = hashlib.sha256(media).digest()
            rows.append((doc_id, media_id, n, [hashlib.sha256(c).digest() for c in _chunks(media)] if seen.add(media_id) else None))
        if rows:
            yield _batch(rows, _ROWS)


def _blobs(batches, hot: frozenset[bytes], of_hot: bool):
    media_seen, chunk_seen = _Seen(REMEMBERED), _Seen(REMEMBERED)
    for batch in shingles.small_batches(batches):
        rows, held = [], 0
        for text in batch.column("text").to_pylist():
            media = to_media(payload_of(text)[0])
            if not media_seen.add(hashlib.sha256(media).digest()):
                continue
            for chunk in _chunks(media):
                digest = hashlib.sha256(chunk).digest()
                if (digest in hot) == of_hot and chunk_seen.add(digest):
                    rows.append((digest, bz2.compress(chunk)))
                    held += len(rows[-1][1])
            if held > _FLUSH:
                yield _batch(rows, _BLOBS)
                rows, held = [], 0
        if rows:
            yield _batch(rows, _BLOBS)


def media_rows(docs: DataFrame) -> DataFrame:
    """doc_id, media_id (digest of the stored form), n_bytes, digests: the ordered chunk list where a task meets a medium first, else null."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(_media_rows, "doc_id long, media_id binary, n_bytes long, digests array<binary>")


def chunk_lists(rows: DataFrame) -> DataFrame:
    """media_id, copies (rows of the medium), n_chunks, seq, digest: the ordered chunk list of each distinct medium."""
    media = rows.groupBy("media_id").agg(F.count("*").alias("copies"), F.first("digests", ignorenulls=True).alias("digests"))
    return media.select("media_id", "copies", F.size("digests").alias("n_chunks"), F.posexplode("digests").alias("seq", "digest"))


def chunk_store(docs: DataFrame, hot: frozenset[bytes] = frozenset(), of_hot: bool = False) -> DataFrame:
    """digest, blob: each distinct chunk once, compressed; either the hot ones or all others."""
    rows = docs.select("text").mapInArrow(lambda it: _blobs(it, hot, of_hot), "digest binary, blob binary")
    return rows.groupBy("digest").agg(F.first("blob").alias("blob"))


def feature_of(payload: bytes) -> str:
    """Integer statistics of the samples: count, sum, energy, crossings of the mid line, 16-bin histogram."""
    x = np.frombuffer(payload, dtype=np.uint8)
    high = x >= 128
    wide = x.astype(np.int64)
    hist = np.bincount(x >> 4, minlength=16)
    return (
        f"pcm8;n={len(x)};sum={int(wide.sum())};energy={int((wide * wide).sum())};"
        f"cross={int(np.count_nonzero(high[1:] != high[:-1]))};hist={','.join(map(str, hist.tolist()))}"
    )


_READ = pa.schema([
    ("media_id", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.binary()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("feature", pa.string()), ("n_chunks", pa.int32()), ("copies", pa.int64()),
])


def _rebuild(batches):
    for batch in batches:
        out = []
        for media_id, copies, parts in zip(*(batch.column(c).to_pylist() for c in ("media_id", "copies", "parts"))):
            media = b"".join(bz2.decompress(p["blob"]) for p in sorted(parts, key=lambda p: p["seq"]))
            if hashlib.sha256(media).digest() != media_id:
                raise ValueError(f"chunks do not rebuild medium {media_id.hex()}")
            payload = from_media(media)
            out.append((
                media_id, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-32:]),
                len(media), feature_of(payload), len(parts), copies,
            ))
        if out:
            yield _batch(out, _READ)


def rebuild(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """Join chunk lists to the store, rebuild and verify each medium, and describe what was read back.

    Chunks with more than a HOT_KEYS-th of all places in lists are fewer than HOT_KEYS; they are broadcast (of
    MAX_CHUNK bytes each at most, so 64 MiB in all) and their places stay where they are. The rest is joined by shuffle.
    """
    total = lists.count()
    crowded = cut_lineage(lists.groupBy("digest").count().where(F.col("count") * HOT_KEYS > total).select("digest"))
    hot = frozenset(bytes(r["digest"]) for r in crowded.collect())
    spread = chunk_store(docs, hot)
    common = F.broadcast(chunk_store(docs, hot, True)) if hot else None

    def with_blobs(part: DataFrame) -> DataFrame:
        if common is None:
            return part.join(spread, "digest")
        rest = part.join(F.broadcast(crowded), "digest", "left_anti").join(spread, "digest")
        return part.join(common, "digest").unionByName(rest)

    piece = F.struct("seq", "blob")
    # A medium of one chunk is whole as soon as the chunk is found; only longer lists are gathered.
    whole = with_blobs(lists.where("n_chunks = 1")).select("media_id", "copies", F.array(piece).alias("parts"))
    longer = with_blobs(lists.where("n_chunks > 1")).groupBy("media_id", "copies").agg(F.collect_list(piece).alias("parts"))
    return whole.unionByName(longer).mapInArrow(
        _rebuild,
        "media_id binary, payload_bytes long, payload_digest binary, tail_crc32 long, media_bytes long, feature string, n_chunks int, copies long",
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per input row: the digests and features of its medium as read back from the chunks."""
    rows = cut_lineage(media_rows(docs))
    described = cut_lineage(rebuild(cut_lineage(chunk_lists(rows)), docs))
    return join_by_weight(rows.drop("digests"), described, ["media_id"], "copies", rows.count()).select(
        "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload_digest")).alias("payload_sha256"), "tail_crc32",
        "media_bytes", F.lower(F.hex("media_id")).alias("media_sha256"), "feature", "n_chunks",
    )


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_media_columns": op1_media_columns}
ORACLE_SQL: dict[str, str] = {}
