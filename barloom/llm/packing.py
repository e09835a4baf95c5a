"""Op 11: packing of tokenised documents into sequences by minimum bin slack.

Every document becomes its ids and an end id. Documents longer than a sequence are
cut into whole sequences, with the rest in front. Which pieces go together depends
on how many there are of each length alone, so the plan is made from that histogram,
which has one row a length at most: the longest length left opens a sequence, the
fullest feasible combination of available lengths beside it is found by subset sums
over bitsets, and taken out as often as the counts allow (it stays the fullest for as
long as it is feasible, so this equals taking it out bin by bin). Pieces then find their places: each has a number among those of
its length, from its task's own count and the sum of the counts of earlier tasks.

No group is gathered anywhere: the driver holds the histogram and the plan, which
CAPACITY bounds, and a piece's place is looked up in a table of runs.

Defined results: a null or empty text is the end id alone; repeated rows and ids
have pieces of their own; very long texts have many pieces; an empty table gives
none. Of pieces of one length, which takes which place is not defined. Other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import read_table, write_shared
from barloom.llm.shingles import small_batches

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 1024, 2
#: Rows of (task, length) up to which their sums are broadcast, about 40 bytes each.
BROADCAST_COUNTS = 400_000
#: Runs of white space from this length are left to the file's own library, which needs no stack for them.
_BLANK = re.compile(r"\s{100000}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    """Ids of a byte-level BPE file, as its own library gives them.

    The file's vocabulary is also handed to a faster implementation, whose merges go by id as the file's
    do; texts that spell one of the file's added tokens, or hold very long runs of white space, go to the library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in self.own.get_vocab().items() if word not in self.added}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if any(a in text for a in self.added) or (len(text) >= 100_000 and _BLANK.search(text)):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of byte-level vocabularies: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("ids", pa.list_(pa.int32())), ("part", pa.int32()), ("place", pa.int64()),
])


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; of more than one, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenised_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless kept), part (the task) and place (among the task's pieces of that length)."""
    path = path or default_tokenizer()

    def run(batches):
        tokenizer, part = _tokenizer(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in small_batches(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*tokenizer.encode(text or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    own = ids[start : start + length]
                    out.append((doc_id, piece, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if keep_ids else None, part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, part int, place long"
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, schema)


#: Slack beyond the least that a combination may have, tried in turn: longer pieces go early for it.
SLACKS = (0, 2, 8, 32)


def fullest(lengths: list[int], counts: dict[int, int], capacity: int, seed: int, slack: int = 0) -> dict[int, int]:
    """The fullest combination of available lengths with a seed among them; of those within the slack of it, the one with the most of the longest.

    lengths ascend. sums[i] has bit s if the first i lengths, as often as there are any, can add up to s.
    """
    room = capacity - seed
    mask, sums, usable = (1 << room + 1) - 1, [1], []
    for length in lengths:
        if length > room:
            break
        reach, left, step = sums[-1], min(counts[length] - (length == seed), room // length), 1
        while left > 0:
            # Copies in doubling bundles: every number of them up to the count is reached.
            step = min(step, left)
            reach |= (reach << length * step) & mask
            left, step = left - step, step * 2
        usable.append(length)
        sums.append(reach)
    most = sums[-1].bit_length() - 1
    least, chosen = max(0, most - slack), {seed: 1}
    for at in range(len(usable) - 1, -1, -1):
        length = usable[at]
        k = min(counts[length] - (length == seed), most // length)
        # As many as leave a sum between least and most to the shorter ones.
        while k and not (sums[at] & ((1 << most - k * length + 1) - 1)) >> max(0, least - k * length):
            k -= 1
        if k:
            chosen[length] = chosen.get(length, 0) + k
            least, most = max(0, least - k * length), most - k * length
    return chosen


def _plan(histogram: dict[int, int], capacity: int, slack: int) -> list[tuple[int, dict[int, int]]]:
    counts, lengths, plan = dict(histogram), sorted(histogram), []
    while lengths:
        # The longest piece left opens a sequence.
        chosen = fullest(lengths, counts, capacity, lengths[-1], slack)
        times = min(counts[n] // k for n, k in chosen.items())
        plan.append((times, chosen))
        for n, k in chosen.items():
            counts[n] -= times * k
        lengths = [n for n in lengths if counts[n]]
    return plan


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths, each with the number of sequences that are filled so: the best of the plans with each slack."""
    bound, best = -(-sum(n * k for n, k in histogram.items()) // capacity), None
    for slack in SLACKS:
        plan = _plan(histogram, capacity, slack)
        size = sum(times for times, _ in plan)
        if best is None or size < best[0]:
            best = size, plan
        if size == bound:
            break
    return best[1]


class Places:
    """From a length and a number among its pieces to a sequence and an offset, by runs of numbers that share a combination."""

    _SHIFT = 50

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        runs, taken, sequence = [], {}, 0
        for times, chosen in plan:
            offset = 0
            for n in sorted(chosen, reverse=True):
                k = chosen[n]
                runs.append(((n << self._SHIFT) + taken.get(n, 0), k, sequence, offset))
                taken[n] = taken.get(n, 0) + k * times
                offset += k * n
            sequence += times
        self.key, self.copies, self.sequence, self.offset = (np.array(c, np.int64) for c in (zip(*sorted(runs)) if runs else ((), (), (), ())))
        self.sequences = sequence

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << self._SHIFT) + number
        run = np.searchsorted(self.key, key, "right") - 1
        past, copy = np.divmod(key - self.key[run], self.copies[run])
        return self.sequence[run] + past, self.offset[run] + copy * length


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, broadcast_counts: int = BROADCAST_COUNTS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id and offset."""
    pieces, _ = write_shared(tokenised_pieces(docs, path, capacity, end_id, keep_ids), "pieces")
    counts, _ = write_shared(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # One row a length: at most CAPACITY rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(pack_lengths(histogram, capacity)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    sums = F.broadcast(sums) if counts.count() <= broadcast_counts else sums
    numbered = pieces.join(sums, ["part", "length"]).withColumn("number", F.col("before") + F.col("place"))

    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = places.value(length, number)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "number").mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (of at most a sequence's length) and parts (doc_id, start, length of each piece in order), from pieces with ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.flatten(F.col("rows.ids")).alias("ids"),
        F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["start"].alias("start"), r["length"].alias("length"))).alias("parts"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


QUERIES = {"op11_packing": op11_packing}
ORACLE_SQL: dict[str, str] = {}
