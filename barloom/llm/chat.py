"""Op 2: chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted, adjacent turns of one
role are merged into a block, and blocks are concatenated:

    <|start|>role newline text [<|next|> text ...] <|end|> newline

`<|next|>` keeps the borders of merged turns, so nothing is lost. Inside roles
and texts `&` becomes `&amp;` and `<|` becomes `&lt;|`; a newline in a role
becomes `&#10;`. No control string can then occur inside a text, and undoing
the replacements in reverse order gives the text back. The loss mask has one
(start, length) span per turn, in code points of that turn's piece of the
output; pieces begin at `<|start|>` or `<|next|>`. Turns that are not trained on
have length 0.

Defined results: null texts and roles are empty; turns sort by turn, then role,
then text, so ties and repeated rows have one order; null turns come first; rows
with a null conv_id form one conversation; an empty table has no conversations;
other columns are ignored. A conversation is one row of output, so its turns are
gathered in one task that holds its whole text. That is the row's own size: where
one conversation, or the rows without an id, hold a large share of all text, the
output has a row as large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read_table

START, NEXT, END = "<|start|>", "<|next|>", "<|end|>\n"
TRAINED_ROLE = "assistant"
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, n_blocks, formatted, loss_mask from rows of (conv_id, turn, role, text)."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def opens(i: Column) -> Column:
        return (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])

    def closes(i: Column) -> Column:
        return (i == F.size("turns") - 1) | (F.get("turns", i)["role"] != F.get("turns", i + 1)["role"])

    def piece(t: Column, i: Column) -> Column:
        head = F.when(opens(i), F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(NEXT))
        body = escape(t["text"])
        trained = t["role"] == TRAINED_ROLE
        return F.struct(
            F.concat(head, body, F.when(closes(i), F.lit(END)).otherwise(F.lit(""))).alias("piece"),
            opens(i).alias("opens"),
            F.when(trained, F.length(head)).otherwise(F.lit(0)).alias("start"),
            F.when(trained, F.length(body)).otherwise(F.lit(0)).alias("length"),
        )

    pieces = chats.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.size(F.filter("pieces", lambda p: p["opens"])).cast("long").alias("n_blocks"),
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss_mask"),
    )


def split_pieces(formatted: Column) -> Column:
    """The formatted text cut before each turn marker."""
    return F.filter(F.split(formatted, r"(?=<\|start\|>|<\|next\|>)", -1), lambda p: p != "")


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read turns and trained text back from `formatted` and `loss_mask`."""
    cut = chats.withColumn("_pieces", split_pieces(F.col("formatted")))
    # A block's role stands in its first piece; later pieces of the block are of the same role.
    block = F.split(F.substring("formatted", len(START) + 1, 2**31 - 1), r"<\|start\|>", -1)

    def turns_of(b: Column) -> Column:
        role = _unescape_role(F.substring_index(b, "\n", 1))
        body = F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))
        body = F.substring(body, F.lit(1), F.length(body) - len(END))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    trained = F.array_join(
        F.transform(
            F.arrays_zip("_pieces", "loss_mask"),
            lambda z: unescape(F.substring(z["_pieces"], z["loss_mask"]["start"] + 1, z["loss_mask"]["length"])),
        ),
        "",
    )
    return cut.withColumn("turns", F.flatten(F.transform(block, turns_of))).withColumn("trained", trained).drop("_pieces")


def chat_digests(rows: DataFrame) -> DataFrame:
    """Digests of what parse_chats reads back."""
    back = parse_chats(format_chats(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return chat_digests(rows.unionByName(probe))


QUERIES = {"op2_chat_formatting": op2_chat_formatting}

#: The escapes cost 4 code points for each & and 3 for each <| in a text; markers: 10 + role + newline, 8, or 8 and a newline.
_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS prev FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, prev IS NULL OR prev <> role AS opens,
    length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS body,
    length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN opens THEN 9 + head + 1 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) AS BIGINT) AS n_blocks
FROM e GROUP BY conv_id
"""
ORACLE_SQL = {"op2_chat_formatting": _SQL}
