"""Op 5: benchmark decontamination with DataFrame expressions only.

Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII code
points. The normalised windows of the benchmark, 13 words each or a whole
shorter item, form a hash set that is broadcast while its measured size is below
BROADCAST_WINDOWS. A larger set is first reduced, by a shuffle of hashes, to windows
whose hash occurs in documents; only where these are too many as well are windows
of documents shuffled with their words. Documents are cut into
overlapping pieces of bounded length, so memory does not follow text length; the
windows of each piece are matched by hash and verified by their words. Matches
alone are shuffled; they are merged per document.

Defined results: null and empty texts have no words and no hits; an empty
benchmark hits nothing; documents shorter than a window can be hit by shorter
items only; repeated rows get equal results, one per row; repeated ids with
different texts are judged separately. Input columns with clashing names are
untouched: results are joined under internal names first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage, read_table

WINDOW = 13
#: Windows are broadcast up to this many (about 100 bytes each).
BROADCAST_WINDOWS = 400_000
#: Characters of a document piece, without the words it shares with the next.
PIECE_CHARS = 16_384
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same classes on text whose case is still as written.
_GAP_AS_WRITTEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD_AS_WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def normalise(text: Column) -> Column:
    """Lower-cased words, each followed by one space; empty without words."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP, " ")
    return F.ltrim(F.concat(F.rtrim(spaced), F.lit(" ")))


def _count_words(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))


def _grams(norm: Column, k: int) -> Column:
    return F.regexp_extract_all(norm, F.lit(rf"(?=((?:[^ ]++ ){{{k}}}))[^ ]++ "), F.lit(1))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, k, gram) of all items that have words."""
    norm = benchmark.select(F.col("item_id").alias("item_id"), normalise(F.col("text")).alias("norm"))
    norm = norm.where(F.col("norm") != "")
    short = _count_words(F.col("norm")) < WINDOW
    rows = norm.select(
        "item_id",
        F.when(short, _count_words(F.col("norm"))).otherwise(WINDOW).cast("int").alias("k"),
        F.explode(F.when(short, F.array("norm")).otherwise(_grams(F.col("norm"), WINDOW))).alias("gram"),
    )
    return rows.distinct()


def _pieces(docs: DataFrame) -> DataFrame:
    """Key, base (index of the piece's first word) and piece, whose last up to 12 words open the next piece."""
    body = rf"(?s)(?:.{{1,{PIECE_CHARS}}}(?<= )|[^ ]++ )"
    shared = rf"(?s)(?=((?:.{{1,{PIECE_CHARS}}}(?<= )|[^ ]++ )(?:[^ ]++ ){{0,{WINDOW - 1}}})){body[4:]}"
    cut = docs.select(
        "_doc", "_text", F.regexp_extract_all("_norm", F.lit(shared), F.lit(1)).alias("pieces"),
        F.transform(F.regexp_extract_all("_norm", F.lit(body), F.lit(0)), _count_words).alias("sizes"),
    )
    return cut.select("_doc", "_text", "sizes", F.posexplode("pieces").alias("at", "piece")).select(
        "_doc", "_text", "piece",
        F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0), lambda a, x: a + x).alias("base"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's identity is its id and its text's digest: equal rows share results."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(text, F.length(text)).alias("_text"), normalise(F.col("text")).alias("_norm"))


def find_hits(docs: DataFrame, benchmark: DataFrame, broadcast_limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per hit document: _doc, _text, spans (sorted array of word start and count), items (sorted strings)."""
    windows = benchmark_windows(benchmark)
    sizes = {r["k"]: r["n"] for r in windows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    wanted = windows.select(F.xxhash64("gram").alias("want_h"), F.col("gram").alias("want"), "item_id")
    pieces = _pieces(_keyed(docs))
    grams = [F.struct(F.lit(k).alias("k"), _grams(F.col("piece"), k).alias("grams")) for k in sorted(sizes) or [WINDOW]]
    by_k = pieces.select("_doc", "_text", "base", F.explode(F.array(*grams)).alias("g")) if len(grams) > 1 else pieces.select("_doc", "_text", "base", grams[0].alias("g"))
    found = by_k.select("_doc", "_text", "base", F.col("g.k").alias("k"), F.posexplode("g.grams").alias("at", "gram"))
    found = found.withColumn("h", F.xxhash64("gram"))
    few = sum(sizes.values()) <= broadcast_limit
    if not few:
        # Hashes alone are shuffled, each once a task; what no document holds need not be looked for again.
        wanted = cut_lineage(wanted.join(found.select(F.col("h").alias("want_h")).distinct(), "want_h", "left_semi"))
        few = wanted.count() <= broadcast_limit
    wanted = F.broadcast(wanted) if few else wanted
    found = found.join(wanted, (F.col("h") == F.col("want_h")) & (F.col("gram") == F.col("want")))
    span = F.struct((F.col("base") + F.col("at")).alias("start"), F.col("k").alias("n"))
    # Repeated rows and overlapping pieces find a window twice; sets make that one.
    return found.groupBy("_doc", "_text").agg(
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted spans."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct(
            (acc["words"] + F.greatest(F.lit(0), end - F.greatest(s["start"], acc["reach"]))).alias("words"),
            F.greatest(acc["reach"], end).alias("reach"),
        )

    return F.aggregate(spans, start, step, lambda acc: acc["words"])


def judge(docs: DataFrame, benchmark: DataFrame, broadcast_limit: int = BROADCAST_WINDOWS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """All input columns, or those to keep, in struct `_row`, with n_words, spans, items, n_hit and contaminated."""
    hits = find_hits(docs, benchmark, broadcast_limit)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("_row"),
        F.col("doc_id").alias("_doc"), F.xxhash64(text, F.length(text)).alias("_text"),
        _count_words(normalise(F.col("text"))).cast("long").alias("n_words"),
    )
    same = own["_doc"].eqNullSafe(hits["_doc"]) & (own["_text"] == hits["_text"])
    joined = own.join(hits, same, "left").select("_row", "n_words", "spans", "items")
    joined = joined.withColumn("n_hit", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long"))
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents") -> DataFrame:
    """Input columns of what stays: contaminated documents go ("documents") or hit words go from all texts ("spans")."""
    if mode == "documents":
        return judge(docs, benchmark).where(~F.col("contaminated")).select("_row.*")
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    judged = judge(docs, benchmark)
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(f"{_WORD_AS_WRITTEN}+{_GAP_AS_WRITTEN}*"), F.lit(0))
    outside = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["n"])))
    lead = F.regexp_extract(F.col("_row.text"), f"^{_GAP_AS_WRITTEN}*", 0)
    cut = F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(F.concat(lead, F.array_join(outside, "")))
    return judged.select(F.col("_row").withField("text", cut).alias("_row")).select("_row.*")


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return judge(docs, benchmark, keep=("doc_id",)).select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_words", "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digests(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))
),
h AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS pos FROM h) GROUP BY rid),
m AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN m USING (rid)
"""
ORACLE_SQL = {"op5_benchmark_decontamination": _SQL}
