"""Chat formatting by prefix-target expansion, in DataFrame functions only.

``format_chat`` makes one training example of every assistant turn: all turns before it as
context, that reply as the only trainable text.  Turns after the last assistant turn would
belong to no example, so a conversation that does not end with one gets a last example
without trainable text (``target_turn`` null) that holds all of its turns.

Template of a turn: ``<|turn:ROLE|>TEXT<|end|>``.  In roles and texts ``\\`` is written ``\\s``
and ``|`` is written ``\\p``, so no mark can occur inside them and both are got back exactly.

Defined cases: null text or role is empty; each row with a null ``conv_id`` is a
conversation of its own, so such rows never meet in one task; turns sort by (turn, role, text), nulls first, repeated rows all stay; an empty table gives no
rows; other columns are ignored.  The context is repeated in each example (that is the
format), so output grows with the square of a conversation's turns, never across conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, sha256_text


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def format_chat(turns: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """Examples (conv_id, example, n_turns, target_turn, text, loss_start, loss_end); the loss span
    counts code points of ``text`` and covers the target's escaped text."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("body"),
        ).alias("t"),
    )
    # An array sorts by its structs' fields in order, nulls first.
    conv = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    conv = conv.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    conv = let(
        conv,
        parts=F.transform(
            "turns",
            lambda t: F.struct(
                (t.role == trainable_role).alias("train"),
                t.turn.alias("turn"),
                F.concat(F.lit("<|turn:"), escape(t.role), F.lit("|>")).alias("head"),
                escape(t.body).alias("body"),
            ),
        ),
    )
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("parts", i - 1).train) | (i == n))
    conv = conv.select("conv_id", "parts", F.posexplode(ends).alias("example", "n_turns"))
    conv = conv.select(
        "conv_id",
        F.col("example").cast("long"),
        F.col("n_turns").cast("long"),
        F.get("parts", F.col("n_turns") - 1).alias("last"),
        F.array_join(F.transform(F.slice("parts", 1, F.col("n_turns")), lambda p: F.concat(p.head, p.body, F.lit("<|end|>"))), "").alias("text"),
    )
    end = F.when(F.col("last.train"), F.length("text") - len("<|end|>"))
    return conv.select(
        "conv_id", "example", "n_turns",
        F.when(F.col("last.train"), F.col("last.turn")).alias("target_turn"),
        "text",
        (end - F.length("last.body")).cast("long").alias("loss_start"),
        end.cast("long").alias("loss_end"),
    )


def parse_chat(text: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text)."""
    turns = F.filter(F.split(text, r"<\|end\|>"), lambda s: s != "")
    body = lambda s: F.substring(s, F.instr(s, "|>") + 2, F.length(s))
    return F.transform(
        turns,
        lambda s: F.struct(
            unescape(F.substring(F.substring_index(s, "|>", 1), len("<|turn:") + 1, F.length(s))).alias("role"),
            unescape(body(s)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and loss spans hold, one row per conversation."""
    loss = F.when(
        F.col("loss_start").isNotNull(),
        unescape(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))),
    )
    read = examples.select("conv_id", "example", "text", F.coalesce(loss, F.lit("")).alias("loss"))
    conv = read.where("conv_id is not null").groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "").alias("trained"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    alone = read.where("conv_id is null")  # conversations of one turn, so of one example
    conv = conv.unionByName(alone.select("conv_id", F.col("text").alias("whole"), F.col("loss").alias("trained"), F.length("text").cast("long").alias("formatted_chars"), F.lit(1).cast("long").alias("n_examples")))
    conv = let(conv, turns=parse_chat(F.col("whole")))
    return conv.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_text(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        sha256_text(F.col("trained")).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
        F.col("n_examples").cast("long"),
    )


#: Each example repeats its context; its length is the sum of its turns' escaped lengths and marks.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length(replace(replace(role || text, '\', '\s'), '|', '\p')) + 16) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) FILTER (WHERE role = 'assistant' OR i = n))::BIGINT AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant' OR i = n) AS n_examples
FROM r GROUP BY conv_id
"""
