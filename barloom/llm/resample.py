"""Op 12: importance resampling towards a target distribution, over position-table n-grams.

Words of each document are rows of (document, position); lead() over the document's
window puts the following words beside each, so a row has the features of every order
that begin there. Features are hashed into BUCKETS; their counts over the corpus and
the target give every bucket's gain, a table of BUCKETS rows that is broadcast. A
document's weight is the sum of the gains of its features; with the noise of its own
id it gives a score, and the highest scores are drawn.

The texts are shuffled once, by row, and both passes over the positions read that
shuffle. Ranks need no single task: rows are dealt by ranges of the score, numbered
inside their range as they are written, and the sizes of the ranges give the rest.

Defined results: a null or empty text has no words, no features and weight 0; a null id
has the noise of the empty text and comes after others in ties; repeated rows are
documents of their own, in any order among themselves; with an empty target all
gains follow the corpus alone; an empty table gives no rows. A text's words are rows
of one task, which spills if they are very many. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import read_table, write_shared
from barloom.llm.decontaminate import normalise
from barloom.sources.local import local_frame

BUCKETS, ORDERS = 10_000, 3
#: Documents with fewer words are not drawn; of the others, so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42


def position_table(docs: DataFrame) -> DataFrame:
    """row (doc_id and a number that tells equal ids apart), pos, f1.. : the bucket of the feature of each order that begins at pos.

    A document without words has one row without features.
    """
    # The id is inside the key, so both passes ask for the same columns and share the shuffle.
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("n"))
    texts = docs.select(row.alias("row"), normalise(F.col("text")).alias("norm")).repartition("row")
    words = F.when(F.col("norm") != "", F.split(F.rtrim("norm"), " "))
    table = texts.select("row", F.posexplode_outer(words).alias("pos", "word"))
    in_text = W.partitionBy("row").orderBy("pos")
    following = [F.lead("word", k).over(in_text).alias(f"next{k}") for k in range(1, ORDERS)]
    table = table.select("row", "word", *following)
    bucket = lambda feature: F.crc32(feature) % BUCKETS
    text, columns = F.col("word"), [bucket(F.col("word")).alias("f1")]
    for k in range(1, ORDERS):
        # concat() of a null is null: no feature runs past the end.
        text = F.concat(text, F.lit(" "), F.col(f"next{k}"))
        columns.append(bucket(text).alias(f"f{k + 1}"))
    return table.select("row", *columns)


def _features(table: DataFrame, *keys: str) -> DataFrame:
    return table.select(*keys, F.explode(F.array(*[f"f{k}" for k in range(1, ORDERS + 1)])).alias("bucket")).where("bucket IS NOT NULL")


def bucket_counts(table: DataFrame) -> DataFrame:
    return _features(table).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain of all buckets from the two tables' counts."""
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    counted = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    counted = counted.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    # BUCKETS rows, whatever the input: the totals may be made in one task.
    total = lambda c: F.sum(c).over(W.partitionBy()) + BUCKETS
    ratio = (F.col("t") + 1) * total("s") / ((F.col("s") + 1) * total("t"))
    return counted.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column) -> Column:
    """Gumbel noise of the id, in thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    table = position_table(docs)
    gains = bucket_gains(bucket_counts(table), bucket_counts(position_table(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))))
    # Words without a following one still have the features of lower orders, so f1 counts words.
    flat = table.select("row", F.col("f1").isNotNull().alias("is_word"), F.posexplode(F.array(*[f"f{k}" for k in range(1, ORDERS + 1)])).alias("order", "bucket"))
    flat = flat.where("bucket IS NOT NULL OR order = 0").join(F.broadcast(gains), "bucket", "left")
    weighed = flat.groupBy("row").agg(
        F.count_if(F.col("is_word") & (F.col("order") == 0)).alias("n_words"),
        F.count("bucket").alias("n_features"),
        F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"),
    )
    doc_id = F.col("row.doc_id")
    return weighed.select(doc_id.alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise(doc_id)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every row."""
    weighed, _ = write_shared(weigh(docs, target), "weights")
    weighed = weighed.withColumn("drawable", F.col("n_words") >= least_words)
    drawn = weighed.where("drawable").count() * percent // 100
    order = (F.col("drawable").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    dealt = weighed.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id is the range's number, then 33 bits of the row's number in it.
    numbered, _ = write_shared(dealt.withColumn("at", F.monotonically_increasing_id()), "ranked")
    numbered = numbered.withColumn("range", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1))
    sizes = numbered.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()
    starts, before = [], 0
    for r in sizes:
        starts.append((r["range"], before))
        before += r["n"]
    # One row a partition.
    placed = numbered.join(F.broadcast(local_frame(docs.sparkSession, starts, "range long, before long")), "range")
    rank = F.col("before") + F.col("place") + 1
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("drawable") & (rank <= drawn), rank).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """Documents that are drawn, with all their columns and their rank; ids must be unique."""
    ranked = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"), F.col("rank"))
    return docs.join(ranked, docs["doc_id"].eqNullSafe(F.col("_drawn"))).drop("_drawn")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read_table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_resampling": op12_resampling}

#: CRC-32 of a feature's bytes, four bits at a step, lower ones first: what each four bits add.
_STEPS = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), k) for k in range(16)]
_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', NULL, row_number() OVER (),
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
),
places AS (SELECT side, rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
next_words AS (
  SELECT side, rid, word, lead(word) OVER (PARTITION BY side, rid ORDER BY i) AS n1, lead(word, 2) OVER (PARTITION BY side, rid ORDER BY i) AS n2 FROM places
),
grams AS MATERIALIZED (
  SELECT side, rid, unnest([word, word || ' ' || n1, word || ' ' || n1 || ' ' || n2]) AS g FROM next_words
),
distinct_grams AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM grams WHERE g IS NOT NULL)),
nibbles AS (
  SELECT g, list_transform(range(0, len(x)), lambda p: CAST(strpos('123456789ABCDEF', x[p + CASE WHEN p % 2 = 0 THEN 2 ELSE 0 END]) AS BIGINT)) AS n
  FROM distinct_grams
),
buckets AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, n), lambda c, b: xor(c >> 4, list_extract(_STEPS_, (xor(c, b) & 15) + 1))), 4294967295::BIGINT) % 10000 AS bucket
  FROM nibbles
),
features AS MATERIALIZED (SELECT side, rid, bucket FROM grams JOIN buckets USING (g)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM features GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (tt + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM counts, totals
),
weights AS (SELECT rid, count(*) AS n, sum(gain) AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (rid) WHERE side = 'd'
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN CAST(place AS BIGINT) END AS rank
FROM ranked
"""
ORACLE_SQL = {"op12_resampling": _SQL.replace("_STEPS_", str(_STEPS))}
