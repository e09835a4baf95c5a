"""Op 13: collocations of two and three words, from sketch bounds and exact automata.

Three steps over the corpus. A count-min sketch of all runs of up to three words is made
first: one row of 2**CELL_BITS cells, which tasks keep as sorted cells with counts and
send as compressed blocks of a part of the cells each, so that parts are added up
apart. A cell's sum bounds the count of every run in it, so runs in cells below the
threshold are out. What is left becomes a bit set of a bounded size, which is broadcast
(it may let runs through that are too rare, never the other way).

Then every task takes its texts in blocks, compiles the block's own candidates into an
automaton (pyahocorasick) and counts all their matches, overlapping ones too. A phrase
stands between delimiters in the automaton and in the text, so matches are whole words
and never run past a piece's end. The counts of all blocks are added up by Spark;
thresholds, the cuts of a phrase and containment are joins of that table with itself.

Memory is bounded by a block, a part of the cells, and the bit set. Automata hold the
candidates of one block, not of the corpus, so the cost follows the text.

Defined results: a null text is empty, a null language is `und`; repeated rows count each;
ties go as the order says; very long texts are cut into blocks between pieces (a piece
without any border is one block); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import read_table, write_shared
from barloom.llm.shingles import WordHashes, mix, small_batches

#: Words of a phrase, least and most; occurrences that make a candidate; rows of a language.
FEWEST, MOST, LEAST, TOP = 2, 3, 10, 2000
#: A candidate goes if a longer one around it has at least this share of its occurrences, in hundredths.
COVERED = 50
UNKNOWN = "und"
#: Cells of the sketch are numbers below 2**CELL_BITS.
CELL_BITS = 44
#: Sums of a task that are held before they are sent on; bits of the filter for each cell, and in all, as a power of two.
HELD_CELLS, FILTER_SHARE, FILTER_BITS = 2_000_000, 16, 28
#: Bytes of text of one automaton, about.
BLOCK_BYTES = 1 << 21
#: Parts into which a language's candidates are ranked before its own ranking.
RANK_PARTS = 256

_UPPER = bytes(range(65, 91))
#: Upper case to lower, tabs to spaces, borders of pieces to line feeds.
_MAP = bytes.maketrans(_UPPER + b"\t.,;:!?\x0b\x0c\r", _UPPER.lower() + b" " + b"\n" * 9)
_BORDER, _SPACES = re.compile(rb" *\n[ \n]*"), re.compile(rb"  +")


def delimited(texts: list[bytes]) -> bytes:
    """Words with one space before and after each, line feeds between pieces."""
    joined = b" " + b"\n".join(texts).translate(_MAP) + b" "
    return _SPACES.sub(b" ", _BORDER.sub(b" \n ", joined))


def runs_of_words(block: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Start and end of every run of up to MOST words within a piece, its cell, and the number of words."""
    data = np.frombuffer(block, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & (data != 10)
    starts, stops = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if not len(starts):
        return starts, stops, np.zeros(0, np.uint64), 0
    # Words of one piece are one byte apart, a space; a border takes three.
    together = starts[1:] - stops[:-1] == 1
    firsts, lasts = [starts], [stops]
    for k in range(1, MOST):
        whole = np.ones(max(0, len(starts) - k), bool)
        for j in range(k):
            whole &= together[j : j + len(whole)]
        firsts.append(starts[: len(whole)][whole])
        lasts.append(stops[k:][whole])
    firsts, lasts = np.concatenate(firsts), np.concatenate(lasts)
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return firsts, lasts, mix(WordHashes(data)(firsts, lasts) ^ salt) >> np.uint64(64 - CELL_BITS), len(starts)


def _blocks(batches, size: int):
    """(lang, delimited text) of about size bytes; one text may give several, cut at borders of pieces."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in small_batches(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            for part in _parts(text or b"", size):
                held.setdefault(UNKNOWN if lang is None else lang, []).append(part)
                total += len(part)
                if total >= size:
                    yield from ((k, delimited(v)) for k, v in held.items())
                    held, total = {}, 0
    yield from ((k, delimited(v)) for k, v in held.items())


_CUT = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


def _parts(text: bytes, size: int):
    while len(text) > size:
        border = _CUT.search(text, size)
        if border is None:
            break
        yield text[: border.start()]
        text = text[border.end() :]
    yield text


def _summed(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cells, counts = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cells)
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
    return cells[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unplanes(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def sketch_blocks(docs: DataFrame, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """part, n, first, steps, counts: the cells of a task's texts in each part of all cells, as compressed steps between sorted cells."""
    width = -(-(1 << CELL_BITS) // parts)

    def sent(cells, counts):
        bounds = np.searchsorted(cells, np.arange(parts + 1, dtype=np.uint64) * np.uint64(width))
        for p in range(parts):
            own, n = cells[bounds[p] : bounds[p + 1]], counts[bounds[p] : bounds[p + 1]]
            if len(own):
                # Steps may pass 32 bits where cells are few.
                steps = np.diff(own, prepend=own[:1])
                yield p, len(own), int(own[0]), _planes(steps), _planes(n.astype(np.uint32))

    def rows(found):
        columns = list(zip(*found))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "n", "first", "steps", "counts"])

    def run(batches):
        cells, counts, held = [], [], 0
        for lang, block in _blocks(batches, block_bytes >> 1):
            own, n = np.unique(runs_of_words(block, lang)[2], return_counts=True)
            cells.append(own)
            counts.append(n)
            held += len(own)
            if held > HELD_CELLS:
                found = _summed(cells, counts)
                cells, counts, held = [found[0]], [found[1]], len(found[0])
                if held > HELD_CELLS // 2:
                    yield rows(sent(*found))
                    cells, counts, held = [], [], 0
        if held:
            yield rows(sent(*_summed(cells, counts)))

    src = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    return src.mapInArrow(run, "part int, n int, first long, steps binary, counts binary")


def heavy_cells(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cells whose sums reach the threshold."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, n, first, steps, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "first", "steps", "counts"))):
                cells = np.cumsum(_unplanes(steps, n, np.uint64), dtype=np.uint64) + np.uint64(first)
                own = held.setdefault(part, [[], [], 0, 0])
                own[0].append(cells)
                own[1].append(_unplanes(counts, n, np.uint32).astype(np.int64))
                own[2] += n
                # Summed when twice as many are held as after the last time.
                if own[2] > max(HELD_CELLS // 4, 2 * own[3]):
                    found = _summed(own[0], own[1])
                    held[part] = [[found[0]], [found[1]], len(found[0]), len(found[0])]
        for cells, counts, _, _ in held.values():
            cells, counts = _summed(cells, counts)
            yield pa.RecordBatch.from_arrays([pa.array(cells[counts >= least].astype(np.int64))], names=["cell"])

    return sketch_blocks(docs, parts, block_bytes).repartition("part").mapInArrow(run, "cell long")


def filter_places(cells: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each cell among 2**bits."""
    with np.errstate(over="ignore"):
        mixed = mix(cells.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return mixed >> np.uint64(64 - bits), mixed & np.uint64((1 << bits) - 1)


class CellFilter:
    """A set of bits for cells, two of them each; a cell that was put in is always found."""

    def __init__(self, bits: int):
        self.bits, self.data = bits, np.zeros(1 << bits - 3, np.uint8)

    def holds(self, cells: np.ndarray) -> np.ndarray:
        bit = lambda p: self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1
        a, b = filter_places(cells, self.bits)
        return (bit(a) & bit(b)).astype(bool)


#: Bits that one row of the filter's table carries.
_CHUNK_BITS = 16


def cell_filter(cells: DataFrame, most_bits: int = FILTER_BITS) -> CellFilter:
    """The bit set, put together from chunks that executors make; at most 2**most_bits bits."""
    bits = min(most_bits, max(_CHUNK_BITS, (FILTER_SHARE * max(1, cells.count()) - 1).bit_length()))

    def places(batches):
        for batch in batches:
            both = np.unique(np.concatenate(filter_places(batch.column("cell").to_numpy(), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both >> _CHUNK_BITS), pa.array(both & ((1 << _CHUNK_BITS) - 1))], names=["chunk", "bit"])

    def chunks(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, bit = (batch.column(c).to_numpy() for c in ("chunk", "bit"))
            order = np.argsort(at, kind="stable")
            found, first = np.unique(at[order], return_index=True)
            for chunk, own in zip(found.tolist(), np.split(bit[order], first[1:])):
                marks = held.setdefault(chunk, np.zeros(1 << _CHUNK_BITS - 3, np.uint8))
                np.bitwise_or.at(marks, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        for chunk, marks in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([marks.tobytes()])], names=["chunk", "bits"])

    found = cells.mapInArrow(places, "chunk long, bit long").repartition("chunk").mapInArrow(chunks, "chunk long, bits binary")
    out, size = CellFilter(bits), 1 << _CHUNK_BITS - 3
    for r in found.collect():
        out.data[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def count_block(block: bytes, lang: str, known: CellFilter) -> tuple[list[str], np.ndarray, int]:
    """Candidates of a block, the number of their matches, and the number of words."""
    firsts, lasts, cells, n = runs_of_words(block, lang)
    good = known.holds(cells)
    firsts, lasts, cells = firsts[good], lasts[good], cells[good]
    _, at = np.unique(cells, return_index=True)
    names, found = _matches(block, firsts[at], lasts[at])
    if found.sum() < len(cells):
        # Every run in a good cell is a match, unless another text of its cell was taken: then all texts are.
        names, found = _matches(block, firsts, lasts)
    return names, found, n


def _matches(block: bytes, firsts: np.ndarray, lasts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The texts at some places, and how often each occurs in the block."""
    import ahocorasick

    names = [p.decode() for p in {block[a:b] for a, b in zip(firsts.tolist(), lasts.tolist())}]
    if not names:
        return [], np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for k, name in enumerate(names):
        automaton.add_word(f" {name} ", k)
    automaton.make_automaton()
    found = np.fromiter(map(itemgetter(1), automaton.iter(block.decode())), np.int64)
    return names, np.bincount(found, minlength=len(names))


def phrase_counts(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, f: exact counts of all runs of up to MOST words with at least so many; a language's words are counted under the empty phrase."""
    cells, _ = write_shared(heavy_cells(docs, least, block_bytes), "heavy-cells")
    known = docs.sparkSession.sparkContext.broadcast(cell_filter(cells, filter_bits))

    def run(batches):
        for lang, block in _blocks(batches, block_bytes):
            names, found, n = count_block(block, lang, known.value)
            columns = [pa.array([lang] * (len(names) + 1)), pa.array([*names, ""]), pa.array(np.append(found, n))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])

    src = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    counted = src.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= least) | (F.col("phrase") == ""))


def _candidates(counts: DataFrame) -> DataFrame:
    words = F.split("phrase", " ")
    return counts.where("phrase <> ''").withColumn("words", words).where(F.size("words") >= FEWEST)


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate, by its lowest-scoring cut."""
    joined = lambda part: F.array_join(part, " ")
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda k: F.struct(
            k.alias("k"), joined(F.slice("words", F.lit(1), k)).alias("left"), joined(F.slice("words", k + 1, F.size("words"))).alias("right")
        ),
    )
    rows = _candidates(counts).select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    rows = rows.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # Decimals of 38 digits: exact while a million times the square of a count has no more.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumns({"top": F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), "down": wide("l") * wide("r")})
    best = F.min(F.struct(F.expr("top DIV down").alias("score"), "k", "l", "r")).alias("best")
    return rows.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def covered(counts: DataFrame, share: int = COVERED) -> DataFrame:
    """lang, phrase of candidates inside a longer one that has its share of their occurrences."""
    longer = _candidates(counts).where(F.size("words") > FEWEST)
    sizes = F.sequence(F.lit(FEWEST), F.size("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    around = longer.select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    return around.join(counts, ["lang", "phrase"]).where(100 * F.col("around") >= share * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first rows."""
    counts, _ = write_shared(phrase_counts(docs, least, **how), "phrase-counts")
    kept = scored(counts).join(covered(counts), ["lang", "phrase"], "left_anti")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    # Every part of a language keeps its first rows, so the language's own ranking takes a bounded number.
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    kept = kept.withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}

_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS o(k)),
f AS (SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS f FROM places GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, p, k, f AS a FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT lang, p, a, cut, p[1:cut] AS lp, p[cut + 1:k] AS rp FROM c, (VALUES (1), (2)) AS o(cut) WHERE cut < k),
s AS (
  SELECT cuts.lang, cuts.p, a, cut, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON cuts.lang = x.lang AND cuts.lp = x.p JOIN f y ON cuts.lang = y.lang AND cuts.rp = y.p
),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, p[1:2] AS p, a FROM c WHERE k = 3 UNION ALL SELECT lang, p[2:3], a FROM c WHERE k = 3),
covered AS (SELECT DISTINCT c.lang, c.p FROM c JOIN inner_parts i ON c.lang = i.lang AND c.p = i.p WHERE 100 * i.a >= 50 * c.a),
kept AS (SELECT best.*, array_to_string(best.p, ' ') AS phrase FROM best ANTI JOIN covered ON best.lang = covered.lang AND best.p = covered.p)
SELECT kept.lang, CAST(row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN n ON kept.lang = n.lang
QUALIFY rank <= 2000
"""
ORACLE_SQL = {"op13_collocations": _SQL}
