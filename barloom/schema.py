"""Schemas of bars, records and state, and the versions that stored results depend on."""

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

BAR_FIELDS = (
    ("trade_date", _S), ("code", _S), ("exchange", _S), ("datetime", _S), ("minute", _S), ("timestamp", _L),
    ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _L), ("amount", _D),
)
BAR_COLUMNS = tuple(name for name, _ in BAR_FIELDS)
BAR_SCHEMA = T.StructType([T.StructField(n, t, False) for n, t in BAR_FIELDS])
#: Output partitions, in addition to the bar columns.
PARTITION_COLUMNS = ("kind", "period", "bucket", "market")
STORED_SCHEMA = T.StructType([*BAR_SCHEMA.fields, *(T.StructField(n, _S, False) for n in PARTITION_COLUMNS)])

DAYS_SCHEMA = "source string, code string, market string, period string, kind string, day string, raw_hash string, digest string, rows long, rule_version string, partition string"
RECEIPTS_SCHEMA = "source string, start string, end string, signature string, sha256 string, rule_version string, validation_version string, warnings string"
RECEIPT_DAYS_SCHEMA = "source string, start string, end string, day string, raw_hash string, digest string, rows long, partition string, preclose_raw array<bigint>"

#: Results are comparable only under the same tag of content digests.
DIGEST_TAG = "qmt-business-v2"
RULE_VERSION = DIGEST_TAG
VALIDATION_VERSION = "scope-validation-1"
PROFILE = "words-16-unverified"

#: Fixed values of the binary format and of the market layout.
HEADER_HEX = "feffffffffffff7f"
RECORD_BYTES = 64
PERIOD_FOLDERS = {"86400": "1d", "60": "1m"}
MARKETS = ("SH", "SZ")
STOCK_PREFIXES = {"SH": ("600", "601", "603", "605", "688", "689"), "SZ": ("000", "001", "002", "003", "300", "301")}
INDEX_CODES = ("000001.SH", "000005.SH", "000300.SH", "000905.SH", "399001.SZ", "399006.SZ")
#: Seconds that the market clock is ahead of UTC; a fixed offset, as named zones had summer time.
CLOCK_OFFSET = 8 * 3600
#: Largest amount that a double holds exactly together with all below it.
EXACT_AMOUNT = 2**53
