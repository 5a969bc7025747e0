"""Chat formatting by prefix-target expansion.

Native: DataFrame functions only. Every assistant turn becomes an example of its
own whose context is all turns before it and whose loss covers that reply alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table

#: Fixed marks of the template: <START><role><AFTER_ROLE><text><END>.
START, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
#: Control strings and what stands for them inside a text; the first comes first.
ESCAPES = (("\\", "\\\\"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TRAINED_ROLE = "assistant"


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """No control string is left in the result, so the marks can be found as they are."""
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """Inverse of escape: doubled backslashes are set aside before the other codes are read."""

    def part(p: Column) -> Column:
        for plain, coded in pairs[1:]:
            p = F.replace(p, F.lit(coded), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def prefix_targets(turns: DataFrame) -> DataFrame:
    """Examples from (conv_id, turn, role, text).

    Columns: conv_id, example (from 0), text, loss_start and loss_chars (code
    points of ``text`` under the loss), complete (holds the whole conversation).
    A conversation that does not end with an assistant turn has one more example
    with nothing under the loss, so that no turn is lost.

    Turns are ordered by turn, then role, then text; a null turn comes first. A
    null role or text is empty. Rows with a null conv_id are one conversation.
    Repeated rows are turns of their own. No rows give no examples.
    """
    blank = F.lit("")
    one = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    conv = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE))
    cut = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    conv = conv.select("conv_id", cut.alias("turns"))
    last = F.size("turns") - 1
    target = lambda t, i: (t["role"] == TRAINED_ROLE) | (i == last)
    picks = F.filter(F.transform("turns", lambda t, i: F.when(target(t, i), i)), lambda i: i.isNotNull())
    rows = conv.select("conv_id", "turns", last.alias("last"), F.posexplode(picks).alias("example", "at"))
    before = F.array_join(F.transform(F.slice("turns", 1, F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    mine = F.element_at("turns", F.col("at") + 1)
    rows = rows.select("conv_id", "example", (F.col("at") == F.col("last")).alias("complete"), before.alias("before"), mine.alias("mine"))
    context = F.concat("before", "mine.head")
    trained = F.col("mine.role") == TRAINED_ROLE
    return rows.select(
        "conv_id", "example", F.concat(context, "mine.body", F.lit(END)).alias("text"), F.length(context).alias("loss_start"),
        F.when(trained, F.length("mine.body")).otherwise(0).alias("loss_chars"), "complete",
    )


def read_turns(text: Column) -> Column:
    """Turns of a formatted text as an array of (role, text)."""
    parts = F.split(text, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        colon = F.instr(p, AFTER_ROLE)
        role = F.substring(p, F.lit(len(START) + 1), colon - 1 - len(START))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substring(p, colon + len(AFTER_ROLE), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    return unescape(F.substring(text, start + 1, chars))


def op7_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation, read back from its examples."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(odd).alias("text"))
    examples = prefix_targets(rows.unionByName(more))
    turns = F.array_join(F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example", F.length("text").alias("chars"), F.when(F.col("complete"), F.size(read_turns(F.col("text")))).alias("n"),
        F.when(F.col("complete"), F.sha2(turns, 256)).alias("sha"), loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    losses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
    out = read.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("sha").alias("turns_sha256"), losses.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return out.select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
lengths AS (
  SELECT *, 6 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '###', '\h'), ':', '\c'))
    + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h')) + 8 AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS of
  FROM rows),
sums AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM lengths)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = of THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM sums GROUP BY conv_id
"""
