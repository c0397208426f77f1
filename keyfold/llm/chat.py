"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of the same
role are merged: the places where a role begins cut the array into blocks, each of which is joined into
one string. Template::

    <s>[SYS]text[/SYS][INST]text[/INST]text</s>[ROLE:name]text[/ROLE]

``[SEP]`` divides turns merged into one block. Inside texts and role names
``\\``, ``[``, ``<`` and ``]`` become ``\\b``, ``\\l``, ``\\g`` and ``\\r``: an escaped text holds no
``[`` or ``<``, so that every such character in the output belongs to the template and
``parse`` gets all turns back. Both ways take time in proportion to the text.

Defined results: a null role or text is empty; empty and very long texts are kept whole; turns with equal
numbers are ordered by role, then text, and all kept, repeated rows too; a null turn number sorts first; a null
conv_id is a conversation of its own; other columns are ignored; an empty table
gives no rows. A conversation is one row of the result, so that it is put together in one task,
however many turns it has; it has to fit there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Template values. Each role: what opens and what closes its block.
BLOCKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
BEGIN, JOINT, OTHER, OTHER_END = "<s>", "[SEP]", "[ROLE:", "[/ROLE]"
#: What closes a block, and what opens one (an assistant's has no opener).
CLOSES = r"\[/SYS\]|\[/INST\]|\[/ROLE\]|</s>"
OPENS = r"^(?:\[SYS\]|\[INST\]|\[ROLE:[^\]\[<]*\])"


def escape(c: Column) -> Column:
    for raw, safe in (("\\", "\\b"), ("[", "\\l"), ("<", "\\g"), ("]", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for safe, raw in (("\\r", "]"), ("\\g", "<"), ("\\l", "["), ("\\b", "\\")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _open(role: Column) -> Column:
    out = F.concat(F.lit(OTHER), escape(role), F.lit("]"))
    for name, (start, _) in BLOCKS.items():
        out = F.when(role == name, F.lit(start)).otherwise(out)
    return out


def _close(role: Column) -> Column:
    out = F.lit(OTHER_END)
    for name, (_, end) in BLOCKS.items():
        out = F.when(role == name, F.lit(end)).otherwise(out)
    return out


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, n_blocks, formatted) of a table (conv_id, turn, role, text)."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    kept = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    kept = kept.withColumn("begins", begins)
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("turns")))

    def block(begin: Column, end: Column) -> Column:
        role = F.get("turns", begin)["role"]
        texts = F.transform(F.slice("turns", begin + 1, end - begin), lambda t: escape(t["text"]))
        return F.concat(_open(role), F.array_join(texts, JOINT), _close(role))

    return kept.select("conv_id", F.size("begins").alias("n_blocks"), F.concat(F.lit(BEGIN), F.array_join(F.zip_with("begins", ends, block), "")).alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation."""
    body = F.substring(formatted, len(BEGIN) + 1, 2147483647)
    named = {end: role for role, (_, end) in BLOCKS.items()}

    def block(held: Column, mark: Column) -> Column:
        opener = F.regexp_extract(held, OPENS, 0)
        role = unescape(F.substring(opener, len(OTHER) + 1, F.length(opener) - len(OTHER) - 1))
        for end, name in named.items():
            role = F.when(mark == end, F.lit(name)).otherwise(role)
        texts = F.split(F.substring(held, F.length(opener) + 1, F.length(held)), r"\[SEP\]", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    marks = F.regexp_extract_all(body, F.lit(CLOSES), F.lit(0))
    return F.flatten(F.zip_with(F.slice(F.split(body, CLOSES, -1), F.lit(1), F.size(marks)), marks, block))


def loss_texts(formatted: Column) -> Column:
    """The assistant texts under the loss mask, unescaped and in order."""
    return F.transform(F.filter(parse(formatted), lambda t: t["role"] == "assistant"), lambda t: t["text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_chat_format: digests read back from the formatted conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = format_chats(rows.unionByName(extra)).withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return done.withColumn("loss", said).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace(replace({0}, '\\', '\\b'), '[', '\\l'), '<', '\\g'), ']', '\\r')"
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w = role, false) AS joins
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length({_ESC.format('text')}) + CASE WHEN joins THEN 5 ELSE CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13
    WHEN 'assistant' THEN 4 ELSE 15 + length({_ESC.format('role')}) END END AS chars FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
