"""Every operator on the driver's tables, each with its SQL twin.

The tables hold no bar files, so frames of bars are made from `events`: the event
type is the code, the date the day, the place in time order the record. OLD is
the state after the first days of the month, NEW is what a later listing shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.binary import le_hex_int, le_word
from barloom.functions.digest import check_digestible, group_digests
from barloom.operators import blocking, changes, evidence, fingerprint, merge, reporting, scope, validate
from barloom.operators.decode import amount_inexact, amount_of
from barloom.schema import BAR_FIELDS, DIGEST_TAG, HEADER_HEX
from barloom.sources.listing import classify_listing, kind_of
from barloom.operators.segments import verdicts
from barloom.sources.records import WORDS, Wanted, range_segments, read_records_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function under its own name together with its SQL."""

    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _e(spark, d) -> DataFrame:
    e = _t(spark, d, "events").select(
        "event_id", "user_id", F.col("event_type").alias("code"), F.date_format("ts", "yyyyMMdd").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts", "value"
    )
    # Places within a day, after the rows of all earlier days: a code's rows are sorted day by day, not in one task.
    earlier = fingerprint.running_offsets(e.groupBy("code", "day").agg(F.count("*").alias("rows")), "code")
    placed = e.withColumn("place", F.row_number().over(W.partitionBy("code", "day").orderBy("ts", "event_id")))
    return placed.join(earlier.drop("rows"), ["code", "day"]).withColumn("rec", F.col("place") + F.col("offset")).drop("place", "offset")


_E = """e AS (SELECT event_id, user_id, event_type AS code, strftime(ts, '%Y%m%d') AS day, epoch_us(ts) AS us, ts, value,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rec FROM events)"""


def _b(spark, d) -> DataFrame:
    v = F.col("value")
    return _e(spark, d).select(
        "code", "day", "rec", "event_id", v.alias("open"), (v + F.col("user_id") % 7 - 1).alias("high"), (v - F.col("user_id") % 5).alias("low"), v.alias("close")
    )


_B = _E + """, b AS (SELECT code, day, rec, event_id, value AS open, value + user_id % 7 - 1 AS high, value - user_id % 5 AS low, value AS close FROM e)"""
_BAD = "(open = 0 OR high = 0 OR low = 0 OR close = 0 OR high < greatest(open, low, close) OR low > least(open, high, close))"

#: State knows the days up to the 24th; since then large values were corrected and clicks of the 7th are gone.
_CUT, _LARGE, _GONE = "20240124", 150.0, "20240107"


def _old(spark, d) -> DataFrame:
    return _e(spark, d).where(F.col("day") <= _CUT)


def _new(spark, d) -> DataFrame:
    e = _e(spark, d).where((F.col("code") != "click") | (F.col("day") != _GONE))
    return e.withColumn("value", F.when(F.col("value") >= _LARGE, F.col("value") + 1).otherwise(F.col("value")))


_OLDNEW = _E + f""", old AS (SELECT * FROM e WHERE day <= '{_CUT}'),
new AS (SELECT event_id, user_id, code, day, us, ts, CASE WHEN value >= {_LARGE} THEN value + 1 ELSE value END AS value, rec FROM e
  WHERE code <> 'click' OR day <> '{_GONE}')"""


def _fp(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code", "day").agg(F.count("*").alias("rows"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("mark"))


_FP = """, fo AS (SELECT code, day, count(*) AS rows, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS mark FROM old GROUP BY 1, 2),
fn AS (SELECT code, day, count(*) AS rows, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS mark FROM new GROUP BY 1, 2)"""


def _with_partition(rows: DataFrame) -> DataFrame:
    market = F.when(F.col("code").isin("click", "view"), "SH").otherwise("SZ")
    kind = F.when(F.col("code") == "error", "index").otherwise("stock")
    rows = rows.withColumn("market", market).withColumn("kind", kind).withColumn("period", F.lit("1d")).withColumn("source", F.concat_ws("/", "market", "code"))
    return rows.withColumn("partition", scope.partition_of(F.col("kind"), F.col("period"), F.col("day"), F.col("market")))


_P = """, pd AS (SELECT *, market || '/' || code AS source,
  'data/kind=' || kind || '/period=1d/bucket=' || substr(day, 1, 6) || '/market=' || market AS partition FROM (
  SELECT DISTINCT code, day, CASE WHEN code IN ('click', 'view') THEN 'SH' ELSE 'SZ' END AS market, CASE WHEN code = 'error' THEN 'index' ELSE 'stock' END AS kind, '1d' AS period FROM e))"""


def _pd(spark, d) -> DataFrame:
    return _with_partition(fingerprint.day_inventory(_e(spark, d), "code"))


@query(f"WITH {_E} SELECT DISTINCT code, day FROM e")
def day_inventory(spark, d):
    return fingerprint.day_inventory(_e(spark, d), "code")


@query(f"WITH {_E} SELECT code, day, rec, value FROM e WHERE day BETWEEN '20240105' AND '20240109'")
def date_bounds(spark, d):
    return scope.select_days(_e(spark, d), "20240105", "20240109").select("code", "day", "rec", "value")


@query(f"WITH {_E} SELECT code, day, rec, value FROM e WHERE day BETWEEN '20240105' AND '20240109' OR us IN (SELECT max(us) FROM e GROUP BY code)")
def date_bounds_with_evidence(spark, d):
    e = _e(spark, d)
    also = e.groupBy("code").agg(F.max("us").alias("us"))
    return scope.select_days(e, "20240105", "20240109", also, ("code", "us")).select("code", "day", "rec", "value")


@query(f"""WITH {_B} SELECT code, blocking, count(*) AS count, string_agg(DISTINCT day, ',' ORDER BY day) AS days
FROM (SELECT *, day BETWEEN '20240105' AND '20240109' AS blocking FROM b WHERE {_BAD}) GROUP BY ALL""")
def ohlc_split(spark, d):
    inside = scope.in_days(F.col("day"), "20240105", "20240109")
    rows = validate.bad_price_summary(_b(spark, d), inside, "code")
    return rows.select("code", "blocking", "count", F.array_join("days", ",").alias("days"))


@query(f"""WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY code, day BETWEEN '20240105' AND '20240109' ORDER BY rec) AS place FROM b WHERE {_BAD})
SELECT code, day BETWEEN '20240105' AND '20240109' AS blocking, day, rec AS record, open, high, low, close FROM r WHERE place <= 10""")
def bad_top10(spark, d):
    inside = scope.in_days(F.col("day"), "20240105", "20240109")
    rows = validate.bad_price_summary(_b(spark, d), inside, "code").select("code", "blocking", F.explode("rows").alias("r"))
    return rows.select("code", "blocking", "r.day", "r.record", "r.open", "r.high", "r.low", "r.close")


@query(f"WITH {_B} SELECT code, day, rec, place FROM (SELECT code, day, rec, row_number() OVER (PARTITION BY code ORDER BY rec) AS place FROM b WHERE {_BAD}) WHERE place <= 10")
def first_n_bad(spark, d):
    return validate.first_bad(_b(spark, d), 10, "code").select("code", "day", "rec", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_OLDNEW}{_FP} SELECT change, count(*) AS days FROM (
SELECT CASE WHEN fo.code IS NULL THEN 'new' WHEN fn.code IS NULL THEN 'removed' WHEN fo.rows = fn.rows AND fo.mark = fn.mark THEN 'reused' ELSE 'revised' END AS change
FROM fn FULL JOIN fo ON fn.code = fo.code AND fn.day = fo.day) GROUP BY 1""")
def classify(spark, d):
    return changes.change_counts(changes.classify_days(_fp(_new(spark, d)), _fp(_old(spark, d)), ("code", "day"), ("rows", "mark")))


@query(f"""WITH {_OLDNEW}{_FP} SELECT coalesce(fn.code, fo.code) AS code, coalesce(fn.day, fo.day) AS day,
CASE WHEN fo.code IS NULL THEN 'new' WHEN fn.code IS NULL THEN 'removed' WHEN fo.rows = fn.rows AND fo.mark = fn.mark THEN 'reused' ELSE 'revised' END AS change
FROM fn FULL JOIN fo ON fn.code = fo.code AND fn.day = fo.day""")
def classify_full(spark, d):
    return changes.classify_days(_fp(_new(spark, d)), _fp(_old(spark, d)), ("code", "day"), ("rows", "mark"))


@query(f"WITH {_OLDNEW}, inc AS (SELECT * FROM new WHERE day >= '20240115') SELECT code, day, rec, value FROM old WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.code = old.code AND inc.day = old.day) UNION ALL SELECT code, day, rec, value FROM inc")
def merge_upsert(spark, d):
    pick = ("code", "day", "rec", "value")
    incoming = _new(spark, d).where("day >= '20240115'").select(*pick)
    return merge.replace_days(_old(spark, d).select(*pick), incoming, ("code", "day"))


@query(f"""WITH {_OLDNEW}, a AS (SELECT code, day, rec, value FROM old), b AS (SELECT code, day, rec, value FROM new WHERE day <= '{_CUT}')
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def except_all(spark, d):
    pick = ("code", "day", "rec", "value")
    return merge.differing(_old(spark, d).select(*pick), _new(spark, d).where(F.col("day") <= _CUT).select(*pick))


@query(f"""WITH {_OLDNEW}{_FP}, r AS (SELECT code AS source, min(day) AS start, max(day) AS "end" FROM fo GROUP BY 1),
q AS (SELECT code AS source, '20240105' AS start, '20240109' AS "end" FROM e GROUP BY 1 UNION ALL SELECT code, '20240105', '20240128' FROM e GROUP BY 1)
SELECT q.source, q.start, q."end", r.start AS receipt_start, r."end" AS receipt_end FROM q JOIN r ON q.source = r.source AND r.start <= q.start AND r."end" >= q."end" """)
def receipt_range(spark, d):
    receipts = _fp(_old(spark, d)).groupBy(F.col("code").alias("source")).agg(F.min("day").alias("start"), F.max("day").alias("end"))
    codes = _e(spark, d).select(F.col("code").alias("source")).distinct()
    asked = [codes.select("source", F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in (("20240105", "20240109"), ("20240105", "20240128"))]
    return changes.covering(asked[0].unionByName(asked[1]), receipts)


@query("""WITH r AS (SELECT o_custkey % 5 AS source, strftime(o_orderdate, '%Y%m%d') AS start, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER), '%Y%m%d') AS "end" FROM orders WHERE o_orderkey % 10 < 3),
q AS (SELECT DISTINCT l_suppkey % 5 AS source, strftime(l_shipdate, '%Y%m%d') AS start, strftime(CAST(l_shipdate AS DATE) + CAST(150 + l_linenumber * 8 AS INTEGER), '%Y%m%d') AS "end" FROM lineitem),
m AS (SELECT source, start, "end", (SELECT min(row(r.start, r."end")) FROM r WHERE r.source = q.source AND r.start <= q.start AND r."end" >= q."end") AS best FROM q)
SELECT source, start, "end", best[1] AS receipt_start, best[2] AS receipt_end FROM m WHERE best IS NOT NULL""")
def receipt_first_cover(spark, d):
    """Many intervals a key: the first receipt around each request, without a join of intervals."""
    text = lambda c: F.date_format(c, "yyyyMMdd")
    orders, items = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    receipts = orders.where("o_orderkey % 10 < 3").select(
        (F.col("o_custkey") % 5).alias("source"), text("o_orderdate").alias("start"), text(F.date_add("o_orderdate", (F.col("o_orderkey") % 200).cast("int"))).alias("end")
    )
    asked = items.select(
        (F.col("l_suppkey") % 5).alias("source"), text("l_shipdate").alias("start"), text(F.date_add("l_shipdate", (150 + F.col("l_linenumber") * 8).cast("int"))).alias("end")
    )
    return changes.first_covering(asked.distinct(), receipts)


@query("""WITH r AS (SELECT o_custkey AS source, strftime(o_orderdate, '%Y%m%d') AS start, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER), '%Y%m%d') AS "end" FROM orders)
SELECT source, min(row(start, "end"))[1] AS receipt_start, min(row(start, "end"))[2] AS receipt_end FROM r WHERE start <= '19960301' AND "end" >= '19960310' GROUP BY source""")
def receipt_around(spark, d):
    """One interval for all keys, as a run asks it."""
    text = lambda c: F.date_format(c, "yyyyMMdd")
    receipts = _t(spark, d, "orders").select(F.col("o_custkey").alias("source"), text("o_orderdate").alias("start"), text(F.date_add("o_orderdate", (F.col("o_orderkey") % 200).cast("int"))).alias("end"))
    return changes.first_around(receipts, "19960301", "19960310")


@query(f"""WITH {_OLDNEW}{_FP}, parts AS (SELECT *, 0 AS part FROM fo UNION ALL SELECT *, 1 FROM fn WHERE day >= '20240110' UNION ALL SELECT code, day, rows + 1, mark, 2 FROM fo WHERE day BETWEEN '20240120' AND '20240122')
SELECT code, day, rows, mark FROM parts QUALIFY row_number() OVER (PARTITION BY code, day ORDER BY part DESC) = 1""")
def newest_of_parts(spark, d):
    """State days from a base and two later parts."""
    base, new = _fp(_old(spark, d)), _fp(_new(spark, d))
    again = base.where(F.col("day").between("20240120", "20240122")).withColumn("rows", F.col("rows") + 1)
    return merge.newest(base, [new.where("day >= '20240110'"), again], ("code", "day"))


@query(f"""WITH {_OLDNEW}{_FP} SELECT coalesce(fn.code, fo.code) AS source, bool_and(fo.code IS NOT NULL AND fn.code IS NOT NULL AND fo.rows = fn.rows AND fo.mark = fn.mark) AS valid
FROM (SELECT * FROM fn WHERE day <= '20240110') fn FULL JOIN (SELECT * FROM fo WHERE day <= '20240110') fo ON fn.code = fo.code AND fn.day = fo.day GROUP BY 1""")
def receipt_corroborated(spark, d):
    rename = lambda df: _fp(df).where("day <= '20240110'").withColumnRenamed("code", "source")
    return changes.corroborated(rename(_new(spark, d)), rename(_old(spark, d)), ("day",), ("rows", "mark"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND s_nationkey < 5 AND l_quantity > 30)")
def exists_scope(spark, d):
    partitions = _t(spark, d, "orders").select(F.col("o_orderkey").alias("partition"), "o_custkey")
    days = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("partition"), "s_nationkey", "l_quantity")
    found = changes.relevant_partitions(partitions, days, (F.col("s_nationkey") < 5) & (F.col("l_quantity") > 30))
    return found.select(F.col("partition").alias("o_orderkey"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_sources(spark, d):
    known = _t(spark, d, "customer").select(F.col("c_custkey").alias("source"))
    listed = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("source"))
    return changes.missing_sources(known, listed).select(F.col("source").alias("c_custkey"))


@query(f"WITH {_B} SELECT day, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM b WHERE {_BAD} GROUP BY 1")
def blocking_codes(spark, d):
    bad = _b(spark, d).where(validate.bad_prices(*(F.col(c) for c in ("open", "high", "low", "close"))))
    return blocking.blocking_codes(bad, "day").select("day", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {_E}{_P} SELECT DISTINCT partition, kind, market FROM pd")
def partition_path(spark, d):
    return _pd(spark, d).select("partition", "kind", "market").distinct()


@query(f"WITH {_E}{_P} SELECT code, day, partition FROM pd WHERE substr(day, 1, 6) BETWEEN '202401' AND '202401'")
def partition_scope(spark, d):
    days = _pd(spark, d)
    return days.where(scope.partition_overlaps(F.col("day"), F.col("period"), "20240110", "20240112")).select("code", "day", "partition")


@query(f"WITH {_E}{_P} SELECT code, day FROM pd WHERE period IN ('1d') AND code IN ('click', 'error')")
def request_scope(spark, d):
    return scope.in_request(_pd(spark, d), ("1d",), ("click", "error")).select("code", "day")


@query(f"WITH {_B} SELECT CASE WHEN {_BAD} THEN 'error' ELSE 'sound' END AS category, count(*) AS n FROM b GROUP BY 1")
def issue_counts(spark, d):
    bad = validate.bad_prices(*(F.col(c) for c in ("open", "high", "low", "close")))
    return reporting.issue_counts(_b(spark, d).select(F.when(bad, "error").otherwise("sound").alias("category")))


@query("SELECT event_id, sha256(concat_ws('|', event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S'))) AS digest FROM events")
def row_digest(spark, d):
    text = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return _t(spark, d, "events").select("event_id", F.sha2(text, 256).alias("digest"))


@query(f"WITH {_E} SELECT code, day, sha256(string_agg(rec || ':' || user_id, '' ORDER BY rec)) AS raw_hash FROM e GROUP BY 1, 2")
def raw_day_hash(spark, d):
    raw = F.encode(F.concat(F.col("rec").cast("string"), F.lit(":"), F.col("user_id").cast("string")), "UTF-8")
    return fingerprint.raw_hashes(_e(spark, d).withColumn("raw", raw), "code")


@query(f"""WITH {_E} SELECT code, count(*) FILTER (WHERE cents <= 0 OR cents <= before) AS breaks, bool_or(coalesce(cents <= 0 OR cents <= before, false)) AS disordered
FROM (SELECT code, CAST(round(value * 100) AS BIGINT) AS cents, lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY code ORDER BY rec) AS before FROM e) GROUP BY 1""")
def time_order(spark, d):
    rows = _e(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return validate.time_order(rows, "code", "rec", "cents")


#: Events of a code and of some users stand for a file, in time order; prices are in thousandths.
_FILES = """f AS (SELECT event_type || '/' || user_id % 60 AS path, epoch_us(ts) // 1000000 AS s, CAST(round(value * 1000) AS BIGINT) AS o, user_id, event_id,
  row_number() OVER (PARTITION BY event_type, user_id % 60 ORDER BY ts, event_id) - 1 AS rec FROM events),
p AS (SELECT path, rec, s, o, o + (event_id % 97 - 1) * 1000 AS h, greatest(0, o - (event_id % 5) * 1000) AS l, o AS c, strftime(make_timestamp((s + 28800) * 1000000), '%Y%m%d') AS day FROM f)"""


def _file_records(spark, d) -> DataFrame:
    e = _t(spark, d, "events").select(
        F.concat_ws("/", "event_type", (F.col("user_id") % 60).cast("string")).alias("path"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000000").alias("w0"),
        F.round(F.col("value") * 1000).cast("long").alias("w1"), "ts", "event_id",
    )
    placed = e.withColumn("rec", F.row_number().over(W.partitionBy("path").orderBy("ts", "event_id")).cast("long") - 1)
    prices = {"w2": F.col("w1") + (F.col("event_id") % 97 - 1) * 1000, "w3": F.greatest(F.lit(0), F.col("w1") - (F.col("event_id") % 5) * 1000), "w4": F.col("w1")}
    return placed.withColumns(prices).withColumns({f"w{k}": F.lit(0).cast("long") for k in (6, 8, 9, 13, 14)})


@query(f"""WITH {_FILES}, r AS (SELECT *, s = 0 OR coalesce(s <= lag(s) OVER (PARTITION BY path ORDER BY rec), false) AS breaks,
  o = 0 OR h = 0 OR l = 0 OR h < greatest(o, l) OR l > least(o, h) AS bad, day BETWEEN '20240105' AND '20240109' AS inside FROM p)
SELECT path, count(*) AS n, CASE WHEN bool_or(breaks) THEN 'invalid-time-order' WHEN bool_or(bad AND inside) THEN 'invalid-ohlc' END AS failure,
  count(*) FILTER (bad AND inside) AS bad_inside, count(*) FILTER (bad AND NOT inside) AS bad_outside, count(DISTINCT day) AS days FROM r GROUP BY path""")
def segment_summary(spark, d):
    """Files cut into ranges of seven records, their segments made apart and joined."""
    found = verdicts(range_segments(_file_records(spark, d), 7, Wanted("20240105", "20240109")))
    bad = lambda side: F.coalesce(F.aggregate("bad", F.lit(0).cast("long"), lambda n, b: n + F.when(b["blocking"] == side, b["count"]).otherwise(0)), F.lit(0))
    return found.select("path", "n", "failure", bad(True).alias("bad_inside"), bad(False).alias("bad_outside"), F.size("inventory").cast("long").alias("days"))


@query(f"""WITH {_FILES}, d AS (SELECT path, day, count(*) AS rows FROM p GROUP BY path, day) SELECT path, day, rows FROM d""")
def segment_inventory(spark, d):
    """Days of the same files: those at the borders of ranges are put together."""
    found = verdicts(range_segments(_file_records(spark, d), 7)).select("path", F.explode("inventory").alias("d"))
    return found.select("path", "d.day", "d.rows")


@query(f"""WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rec) AS place FROM p WHERE o = 0 OR h = 0 OR l = 0 OR h < greatest(o, l) OR l > least(o, h))
SELECT path, rec AS record, day, o / 1000.0::DOUBLE AS open, h / 1000.0::DOUBLE AS high, l / 1000.0::DOUBLE AS low FROM r WHERE place <= 10""")
def segment_bad_rows(spark, d):
    """The first bad rows of each file, from segments that keep their own first ones."""
    found = verdicts(range_segments(_file_records(spark, d), 7)).select("path", F.explode("bad").alias("b")).select("path", F.explode("b.rows").alias("r"))
    return found.select("path", "r.record", "r.day", "r.open", "r.high", "r.low")


@query(f"WITH {_E} SELECT code, day, min(rec) AS first_rec, count(*) AS rows FROM e GROUP BY 1, 2")
def day_groups(spark, d):
    return fingerprint.day_groups(_e(spark, d), "code")


@query(f"WITH {_E}, g AS (SELECT code, day, count(*) AS rows FROM e GROUP BY 1, 2) SELECT code, day, CAST(coalesce(sum(rows) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g")
def prefix_sum(spark, d):
    return fingerprint.running_offsets(fingerprint.day_groups(_e(spark, d), "code"), "code").select("code", "day", F.col("offset").alias("start"))


@query(f"WITH {_OLDNEW} SELECT DISTINCT code, day FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.code = old.code AND new.day = old.day)")
def removed_days(spark, d):
    return changes.removed_days(fingerprint.day_inventory(_old(spark, d), "code"), fingerprint.day_inventory(_new(spark, d), "code"), "code")


@query(f"""WITH {_OLDNEW}, inc AS (SELECT * FROM new WHERE user_id < 100 AND day <= '{_CUT}') SELECT code, day, event_id FROM old
WHERE EXISTS (SELECT 1 FROM inc WHERE inc.code = old.code AND inc.day = old.day) AND NOT EXISTS (SELECT 1 FROM inc WHERE inc.code = old.code AND inc.event_id = old.event_id)""")
def removed_records(spark, d):
    incoming = _new(spark, d).where((F.col("user_id") < 100) & (F.col("day") <= _CUT))
    return merge.removed_records(_old(spark, d), incoming, ("code", "day"), ("code", "event_id")).select("code", "day", "event_id")


@query(f"WITH {_OLDNEW} SELECT old.code, old.event_id, coalesce(old.value = new.value, false) AS matched FROM old LEFT JOIN new ON old.code = new.code AND old.event_id = new.event_id")
def evidence_match(spark, d):
    return evidence.match_values(_old(spark, d), _new(spark, d), ("code", "event_id"), ("value",))


@query(f"""WITH {_OLDNEW}, m AS (SELECT coalesce(old.value = new.value, false) AS matched FROM old LEFT JOIN new ON old.code = new.code AND old.event_id = new.event_id)
SELECT count(*) FILTER (WHERE matched) AS matched, count(*) AS expected, CASE WHEN bool_and(matched) THEN 'matched' ELSE 'mismatch' END AS status FROM m""")
def evidence_summary(spark, d):
    m = evidence.match_values(_old(spark, d), _new(spark, d), ("code", "event_id"), ("value",))
    return m.agg(F.count_if("matched").alias("matched"), F.count("*").alias("expected"), F.when(F.bool_and("matched"), "matched").otherwise("mismatch").alias("status"))


@query(f"""WITH {_OLDNEW} SELECT old.event_id AS item, coalesce(old.value = new.value AND old.user_id = new.user_id, false) AS matched
FROM old LEFT JOIN new ON old.code = new.code AND old.event_id = new.event_id""")
def evidence_fields(spark, d):
    """Expected values of three types, a row a field, as the engine compares them with bars."""
    texts, wholes, numbers = (F.lit(None).cast(k) for k in ("string", "long", "double"))
    field = lambda name, text=texts, whole=wholes, number=numbers: F.struct(F.lit(name).alias("field"), text.alias("text"), whole.alias("whole"), number.alias("number"))
    expected = F.explode(F.array(field("close", number=F.col("value")), field("volume", whole=F.col("user_id").cast("long")), field("code", text=F.col("code"))))
    wanted = _old(spark, d).select(F.col("event_id").alias("item"), "code", F.lit("1d").alias("period"), F.col("event_id").alias("timestamp"), expected.alias("e")).select("item", "code", "period", "timestamp", "e.*")
    columns = {"code": F.col("code"), "timestamp": F.col("event_id"), "volume": F.col("user_id").cast("long")}
    other = {"string": F.lit(""), "long": F.lit(0), "double": F.col("value")}
    bars = _new(spark, d).select(*[columns.get(name, other[kind.typeName()]).alias(name) for name, kind in BAR_FIELDS], F.lit("1d").alias("period"))
    return evidence.match_evidence(wanted, bars)


@query(f"WITH {_OLDNEW} SELECT code, day, rec FROM old WHERE EXISTS (SELECT 1 FROM new WHERE new.code = old.code AND new.day = old.day AND new.day >= '20240120')")
def verify_semi(spark, d):
    return merge.same_keys(_old(spark, d), _new(spark, d).where("day >= '20240120'"), ("code", "day")).select("code", "day", "rec")


@query(f"WITH {_E}{_P}, f AS (SELECT DISTINCT source FROM pd WHERE code = 'error') SELECT DISTINCT partition, code FROM pd WHERE source IN (SELECT source FROM f)")
def block_source(spark, d):
    days = _pd(spark, d)
    return blocking.blocked_by_source(days, days.where("code = 'error'"))


@query(f"WITH {_B}{_P} SELECT DISTINCT partition, pd.code FROM pd JOIN b ON b.code = pd.code AND b.day = pd.day WHERE {_BAD.replace('open', 'b.open', 1)} AND b.day < '20240103'")
def block_day(spark, d):
    bad = _b(spark, d).where(validate.bad_prices(*(F.col(c) for c in ("open", "high", "low", "close"))) & (F.col("day") < "20240103"))
    return blocking.blocked_by_day(_pd(spark, d).join(bad.select("code", "day").distinct(), ["code", "day"]))


@query(f"""WITH {_E}{_P}, failed AS (SELECT DISTINCT source, period, market, kind, code FROM pd WHERE code IN ('view', 'error')), known AS (SELECT * FROM pd WHERE code <> 'view')
SELECT DISTINCT pd.code, pd.partition FROM pd JOIN (SELECT DISTINCT period, market, kind FROM failed WHERE source NOT IN (SELECT source FROM known)) g USING (period, market, kind)""")
def block_group(spark, d):
    days = _pd(spark, d)
    failed = days.where("code IN ('view', 'error')").select("source", "period", "market", "kind", "code").distinct()
    groups = blocking.groups_without_history(failed, days.where("code <> 'view'"))
    return blocking.blocked_in_groups(days, groups).select("code", "partition").distinct()


@query(f"""WITH {_E}{_P}, touched AS (SELECT DISTINCT partition FROM pd WHERE code = 'click')
SELECT DISTINCT partition, source FROM pd WHERE partition IN (SELECT partition FROM touched)""")
def affected_sources(spark, d):
    days = _pd(spark, d)
    return blocking.affected_sources(days.where("code = 'click'"), days)


@query(f"""WITH {_OLDNEW}, a AS (SELECT code, count(DISTINCT day) AS n FROM old GROUP BY 1), b AS (SELECT code, count(DISTINCT day) AS n FROM e GROUP BY 1)
SELECT b.code AS source, coalesce(a.n, 0) AS cached_days, b.n AS source_days, coalesce(a.n, 0) = b.n AS complete FROM b LEFT JOIN a ON a.code = b.code""")
def complete_flag(spark, d):
    days = lambda df: fingerprint.day_inventory(df, "code").withColumnRenamed("code", "source")
    return changes.completeness(days(_old(spark, d)), days(_e(spark, d)))


@query("SELECT event_type AS reason, count(*) AS n, (SELECT count(DISTINCT event_type) FROM events) AS reasons FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 3")
def top3_reasons(spark, d):
    return reporting.top_reasons(_t(spark, d, "events").select(F.col("event_type").alias("reason")))


@query("SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) > 100 AS more FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def issue_cap(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", "c_acctbal", (-F.col("c_acctbal")).alias("order"))
    return reporting.shown(rows, 100, "order", "c_custkey").drop("order")


@query(f"WITH {_E} SELECT code, array_to_string(list_sort(list(DISTINCT day))[1:2], ',') AS head, count(DISTINCT day) AS total FROM e GROUP BY 1")
def brief_days(spark, d):
    return reporting.brief(_e(spark, d), "code", "day")


@query(f"WITH {_OLDNEW} SELECT code, day FROM (SELECT code, day FROM old EXCEPT SELECT code, day FROM new)")
def set_difference(spark, d):
    return _old(spark, d).select("code", "day").subtract(_new(spark, d).select("code", "day"))


@query(f"WITH {_OLDNEW} SELECT code, day FROM (SELECT code, day FROM old INTERSECT SELECT code, day FROM new)")
def set_intersect(spark, d):
    return _old(spark, d).select("code", "day").intersect(_new(spark, d).select("code", "day"))


@query(f"WITH {_OLDNEW} SELECT code, day FROM (SELECT code, day FROM old UNION SELECT code, day FROM new)")
def set_union(spark, d):
    return _old(spark, d).select("code", "day").union(_new(spark, d).select("code", "day")).distinct()


@query(f"WITH {_OLDNEW} SELECT code, bool_and(day IN (SELECT n.day FROM new n WHERE n.code = old.code)) AS subset FROM old GROUP BY 1")
def set_subset(spark, d):
    old, new = (fingerprint.day_inventory(x, "code") for x in (_old(spark, d), _new(spark, d)))
    joined = old.join(new.withColumn("has", F.lit(True)), ["code", "day"], "left")
    return joined.groupBy("code").agg(F.bool_and(F.coalesce("has", F.lit(False))).alias("subset"))


@query(f"WITH {_OLDNEW} SELECT coalesce(o.code, n.code) AS source, bool_and(o.code IS NOT NULL AND n.code IS NOT NULL) AS valid FROM (SELECT DISTINCT code, day FROM old) o FULL JOIN (SELECT DISTINCT code, day FROM new) n ON o.code = n.code AND o.day = n.day GROUP BY 1")
def set_equality(spark, d):
    days = lambda df: fingerprint.day_inventory(df, "code").withColumnRenamed("code", "source")
    return changes.corroborated(days(_new(spark, d)), days(_old(spark, d)), ("day",), ())


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 1000 + l_linenumber AS word FROM lineitem")
def le_word_decode(spark, d):
    number = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", le_word(F.unhex(le_hex_int(number, 8)), 0, 8).alias("word"))


@query("SELECT o_orderkey, CASE WHEN hi > 2097152 OR (hi = 2097152 AND lo > 0) THEN NULL ELSE CAST(lo + hi * 4294967296 AS DOUBLE) END AS amount, hi > 2097152 OR (hi = 2097152 AND lo > 0) AS inexact FROM (SELECT o_orderkey, o_custkey AS lo, o_orderkey * 200 AS hi FROM orders)")
def amount_words(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("lo"), (F.col("o_orderkey") * 200).alias("hi"))
    return rows.select("o_orderkey", amount_of(F.col("lo"), F.col("hi")).alias("amount"), amount_inexact(F.col("lo"), F.col("hi")).alias("inexact"))


@query("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d') AS trade_date, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS datetime, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS minute,
CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000 AS timestamp, user_id / 1000.0::DOUBLE AS price FROM events""")
def clock_columns(spark, d):
    from barloom.functions.clock import compact_day, market_clock

    rows = _t(spark, d, "events").withColumn("w0", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"))
    clock = market_clock(F.col("w0"))
    return rows.select(
        "event_id", compact_day(clock).alias("trade_date"), F.date_format(clock, "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.date_format(clock, "HH:mm").alias("minute"),
        (F.col("w0") * 1000).alias("timestamp"), (F.col("user_id") / 1000).cast("double").alias("price"),
    )


@query("""SELECT p_partkey, code, CASE WHEN code IN ('000001.SH', '000005.SH', '000300.SH', '000905.SH', '399001.SZ', '399006.SZ') THEN 'index'
WHEN market = 'SH' AND substr(code, 1, 3) IN ('600', '601', '603', '605', '688', '689') THEN 'stock'
WHEN market = 'SZ' AND substr(code, 1, 3) IN ('000', '001', '002', '003', '300', '301') THEN 'stock' END AS kind
FROM (SELECT p_partkey, market, lpad(CAST((p_partkey * 311) % 1000000 AS VARCHAR), 6, '0') || '.' || market AS code FROM (SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'SH' ELSE 'SZ' END AS market FROM part))""")
def classify_codes(spark, d):
    market = F.when(F.col("p_size") <= 25, "SH").otherwise("SZ")
    code = F.concat(F.lpad(((F.col("p_partkey") * 311) % 1_000_000).cast("string"), 6, "0"), F.lit("."), market)
    return _t(spark, d, "part").select("p_partkey", code.alias("code"), kind_of(code).alias("kind"))


@query("SELECT a.o_custkey AS source, a.n AS size, b.n AS was FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) b ON a.o_custkey = b.o_custkey AND a.n < b.n")
def shrunk_sources(spark, d):
    orders = _t(spark, d, "orders")
    size = lambda df: df.groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("size"))
    return changes.shrunk(size(orders.where("o_orderstatus = 'F'")), size(orders))


@query(f"WITH {_E} SELECT code, day, count(*) FILTER (WHERE value IS NULL OR code IS NULL) = 0 AS sound FROM e GROUP BY 1, 2")
def not_null(spark, d):
    return _e(spark, d).groupBy("code", "day").agg((F.count_if(F.col("value").isNull() | F.col("code").isNull()) == 0).alias("sound"))


def _sql_le(number: str, size: int) -> str:
    """Little-endian hex of a number in SQL, from its padded hex text."""
    return f"list_transform([lpad(to_hex({number}), {2 * size}, '0')], lambda h: " + " || ".join(f"substr(h, {2 * k + 1}, 2)" for k in reversed(range(size))) + ")[1]"


def _sql_digest() -> str:
    """Per code and day: SHA-256 over the tag, the number of rows, and each column of the ordered bars (offsets and bytes of texts, 8 bytes of numbers)."""
    texts = {"trade_date": "day", "code": "code", "exchange": "'SH'", "datetime": "dt", "minute": "mi"}
    parts = [f"hex('{DIGEST_TAG}')", "'00'", _sql_le("count(*)::BIGINT", 8)]
    order = "ORDER BY ms, v, u"
    for name, kind in BAR_FIELDS:
        if name in texts:
            width = f"strlen(any_value({texts[name]}))"
            steps = f"list_transform(range(0, count(*) + 1), lambda i: lpad(to_hex(i * {width}), 8, '0'))"
            swapped = f"list_transform({steps}, lambda h: substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))"
            parts += [f"array_to_string({swapped}, '')", f"string_agg(hex({texts[name]}), '' {order})"]
        else:
            number = {"timestamp": "ms", "volume": "u"}.get(name, "bits")
            parts.append(f"string_agg({number}_le, '' {order})")
    return f"""WITH r AS (SELECT event_type AS code, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, strftime(ts, '%H:%M') AS mi,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000 AS ms, value AS v, user_id AS u FROM events),
x AS (SELECT *, {_sql_le("ms", 8)} AS ms_le, {_sql_le("u", 8)} AS u_le, {_sql_le("CAST(CAST(v AS DOUBLE) AS BIT)::UBIGINT", 8)} AS bits_le FROM r)
SELECT code, day, count(*) AS rows, sha256(unhex({" || ".join(parts)})) AS digest FROM x GROUP BY code, day"""


@query(_sql_digest())
def content_digest(spark, d):
    value, seconds = F.col("value").cast("double"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    bars = _t(spark, d, "events").select(
        F.date_format("ts", "yyyyMMdd").alias("trade_date"), F.col("event_type").alias("code"), F.lit("SH").alias("exchange"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.date_format("ts", "HH:mm").alias("minute"), (seconds * 1000).alias("timestamp"),
        *[value.alias(c) for c in ("open", "high", "low", "close")], F.col("user_id").alias("volume"), value.alias("amount"),
    )
    check_digestible(bars.columns)
    return group_digests(bars, "code", "trade_date").withColumnRenamed("trade_date", "day").select("code", "day", "rows", "digest")


@query("SELECT o_orderkey, rec, " + ", ".join(f"(o_orderkey * {7919 * (k + 1)} + rec * {k + 1}) % 4294967296 AS w{k}" for k in WORDS) + " FROM (SELECT o_orderkey, unnest(range(0, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END)) AS rec FROM orders)")
def record_decode(spark, d):
    """Files of one or two records, made byte by byte, and their words."""
    word = lambda k, rec: le_hex_int((F.col("o_orderkey") * (7919 * (k + 1)) + rec * (k + 1)) % 2**32)
    record = lambda rec: F.concat(*[word(k, rec) for k in range(16)])
    content = F.unhex(F.concat(F.lit(HEADER_HEX), record(0), F.when(F.col("o_orderkey") % 3 == 0, record(1)).otherwise("")))
    rows = read_records_sql(_t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), content.alias("content")))
    return rows.select(F.col("path").alias("o_orderkey"), F.col("rec").cast("long").alias("rec"), *[f"w{k}" for k in WORDS])


_LISTED = """SELECT p_partkey, market, p_size % 11 <> 0 AS readable,
  CASE WHEN p_size % 7 = 0 THEN 'odd' ELSE '' END || lpad(CAST((p_partkey * 311) % 1000000 AS VARCHAR), 6, '0') || CASE WHEN p_size % 2 = 0 THEN '.DAT' ELSE '.dat' END AS name
  FROM (SELECT p_partkey, p_size, CASE WHEN p_size <= 25 THEN 'SH' ELSE 'SZ' END AS market FROM part)"""


@query(f"""WITH l AS ({_LISTED}), c AS (SELECT *, CASE WHEN regexp_full_match(name, '[0-9]{{6}}\\.(?i:dat)') THEN substr(name, 1, 6) || '.' || market END AS code FROM l),
k AS (SELECT *, CASE WHEN code IN ('000001.SH', '000005.SH', '000300.SH', '000905.SH', '399001.SZ', '399006.SZ') THEN 'index'
  WHEN market = 'SH' AND substr(code, 1, 3) IN ('600', '601', '603', '605', '688', '689') THEN 'stock'
  WHEN market = 'SZ' AND substr(code, 1, 3) IN ('000', '001', '002', '003', '300', '301') THEN 'stock' END AS kind FROM c)
SELECT p_partkey, code, kind, CASE WHEN code IS NULL THEN 'nonstandard-name' WHEN kind IS NULL THEN 'unclassified' WHEN right(code, 4) = '7.SZ' THEN 'code-filter' WHEN NOT readable THEN 'inaccessible-file' END AS reason,
  CASE WHEN code IS NULL THEN 'malformed' WHEN kind IS NULL OR right(code, 4) = '7.SZ' OR NOT readable THEN 'excluded' END AS category FROM k""")
def listing_reasons(spark, d):
    part = _t(spark, d, "part")
    market = F.when(F.col("p_size") <= 25, "SH").otherwise("SZ")
    number = F.lpad(((F.col("p_partkey") * 311) % 1_000_000).cast("string"), 6, "0")
    name = F.concat(F.when(F.col("p_size") % 7 == 0, "odd").otherwise(""), number, F.when(F.col("p_size") % 2 == 0, ".DAT").otherwise(".dat"))
    listing = part.select("p_partkey", market.alias("market"), (F.col("p_size") % 11 != 0).alias("readable"), name.alias("name"))
    found = classify_listing(listing, wanted=~F.col("code").endswith("7.SZ"))
    return found.select("p_partkey", "code", "kind", "reason", "category")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS source, strftime(o_orderdate, '%Y%m') AS day FROM orders), n AS (SELECT DISTINCT c_custkey AS source FROM customer WHERE c_nationkey < 5)
SELECT source, day FROM d WHERE source IN (SELECT source FROM n)""")
def evidence_needs(spark, d):
    days = _t(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.date_format("o_orderdate", "yyyyMM").alias("day")).distinct()
    needs = _t(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("source"))
    return merge.same_keys(days, needs, ("source",))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Per code and day of the scope: fingerprint, and the number of bad price rows."""
    rows = _b(spark, d)
    bad = validate.bad_prices(*(F.col(c) for c in ("open", "high", "low", "close")))
    prints = rows.groupBy("code", "day").agg(F.count("*").alias("rows"), F.sum(F.round(F.col("close") * 1000).cast("long")).alias("mark"), F.count_if(bad).alias("bad_rows"))
    return prints.where(scope.in_days(F.col("day"), "20240105", "20240125"))


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""WITH {_B} SELECT code, day, count(*) AS rows, CAST(sum(CAST(round(close * 1000) AS BIGINT)) AS BIGINT) AS mark, count(*) FILTER (WHERE {_BAD}) AS bad_rows
FROM b WHERE day BETWEEN '20240105' AND '20240125' GROUP BY 1, 2"""
