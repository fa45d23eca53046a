"""Relational chat formatting (operator 5), Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
become one block by array functions; blocks are concatenated with their marks. Inside
texts and roles ``&`` and ``<`` are escaped, so no text holds a mark and all can be read
back. A block keeps its turns apart with a mark of its own.

The mask is run-length coded beside the text: pieces of so many characters (code points),
trained on or not. Assistant texts are trained on, marks never.

Defined results: a null role or text counts as empty; turns are ordered by turn (nulls
first), role and text, so ties have one result; repeated rows are repeated turns; rows with
a null id are one conversation; an empty table gives no rows; extra columns are ignored.
A conversation is one row, so one task holds it as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: its id, ``formatted`` string and ``mask`` array of (chars, trained)."""
    rows = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    at = lambda i: F.get("turns", i)
    opens = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    talks = talks.withColumn("opens", opens)

    def block(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("opens", k + 1), F.size("turns"))
        return F.struct(at(first)["role"].alias("role"), F.transform(F.slice("turns", first + 1, after - first), lambda t: t["text"]).alias("texts"))

    talks = talks.withColumn("blocks", F.transform("opens", block))
    piece = lambda text, trained: F.struct(text.alias("text"), trained.alias("trained"))
    mark = lambda text: piece(text, F.lit(False))

    def pieces(b: Column) -> Column:
        texts = F.transform(b["texts"], lambda t, i: F.array(mark(F.when(i == 0, F.concat(F.lit(OPEN), escaped(b["role"]), F.lit(HEAD))).otherwise(F.lit(NEXT))), piece(escaped(t), b["role"] == TRAINED)))
        return F.concat(F.flatten(texts), F.array(mark(F.lit(CLOSE))))

    talks = talks.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))
    return talks.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["text"]).alias("chars"), p["trained"].alias("trained"))).alias("mask"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    blocks = F.filter(F.split(text, r"<\|end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        parts = F.split(F.substring_index(b, HEAD, -1), r"<\|next\|>")
        role = unescaped(F.replace(F.substring_index(b, HEAD, 1), F.lit(OPEN), F.lit("")))
        return F.transform(parts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


#: A mark, or a text between marks.
SEGMENT = r"<\|turn\|>[^<]*<\|text\|>|<\|next\|>|<\|end\|>\n|[^<]+"


def trained_text(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, piece by piece.

    The mask's pieces are the text's segments, of which empty ones leave no trace.
    """
    said = F.filter(mask, lambda m: m["chars"] > 0)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)).alias("segment"), said.alias("m"))
    under = F.filter(zipped, lambda z: z["m"]["trained"])
    fits = lambda z: F.length(z["segment"]) == z["m"]["chars"]
    return F.array_join(F.transform(under, lambda z: F.when(fits(z), unescaped(z["segment"])).otherwise(F.raise_error(F.lit("the mask is not of this text")))), "")


def digest(turns: DataFrame) -> DataFrame:
    got = formatted(turns).withColumn("back", read_back(F.col("formatted"))).withColumn("loss", trained_text(F.col("formatted"), F.col("mask")))
    return got.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same from the table itself, with the format's lengths added up.
ORACLE_SQL = """
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS earlier FROM all_turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', ''))) AS n,
    length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', ''))) AS r,
    earlier IS NULL OR earlier <> role AS opens
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN opens THEN 8 + r + 8 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
