"""Operator 10: chat formatting, with Spark expressions only.

Turns are collected a conversation as structs, sorted, adjacent turns of one role merged by an array fold, and the
whole conversation concatenated with role marks. One shuffle, on the conversation.

Defined results:
- turns sort by (turn, role, text), nulls first, so ties and repeated rows have one order; repeated rows stay;
- a null role is ``user``; roles are compared after trimming and lower-casing; a null text counts as empty;
- a turn whose text is empty or spaces only is left out; a conversation without any other turn has an empty chat;
- text that looks like a mark is kept from acting as one: ``<|`` in a text is written ``<\\|``;
- rows with a null conv_id form one conversation of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINT = "\n\n"


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role become one message; their texts are kept as an array until the end."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(done: Column, turn: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when((F.size(done) > 0) & (last["role"] == turn["role"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(fresh)))

    return F.aggregate(turns, empty, step)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_messages, chat) of every conversation."""
    role = F.coalesce(F.lower(F.trim("role")), F.lit("user"))
    text = F.replace(F.trim(F.coalesce("text", F.lit(""))), F.lit("<|"), F.lit("<\\|"))
    one = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    kept = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("all")).select("conv_id", F.filter("all", lambda t: t["text"] != "").alias("turns"))
    merged = kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _merged(F.col("turns")).alias("messages"))
    shown = F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.array_join(m["texts"], JOINT), F.lit("\n<|end|>")))
    return merged.select("conv_id", "n_turns", F.size("messages").cast("long").alias("n_messages"), F.array_join(shown, "\n").alias("chat"))


ORACLE_SQL = r"""
WITH cleaned AS (
  SELECT conv_id, turn, coalesce(lower(trim(role, ' ')), 'user') AS role,
         replace(trim(coalesce(text, ''), ' '), '<|', '<\|') AS text
  FROM conversations
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM cleaned WHERE text <> ''
), marked AS (
  SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY k) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS fresh FROM kept
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY k) AS message FROM marked
), messages AS (
  SELECT conv_id, message, min(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY k) AS body, count(*) AS n
  FROM numbered GROUP BY conv_id, message
), chats AS (
  SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, count(*) AS n_messages,
         string_agg('<|' || role || '|>' || chr(10) || body || chr(10) || '<|end|>', chr(10) ORDER BY message) AS chat
  FROM messages GROUP BY conv_id
)
SELECT a.conv_id, coalesce(c.n_turns, 0) AS n_turns, coalesce(c.n_messages, 0) AS n_messages, coalesce(c.chat, '') AS chat
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN chats c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""
