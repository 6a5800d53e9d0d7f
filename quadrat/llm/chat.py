r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one string, ``<turn ROLE>TEXT</turn>`` for each turn. Roles and texts escape
the characters that the template uses: backslash as ``\b``, ``<`` as ``\l``, ``>`` as ``\g``; no raw
``<`` or ``>`` remains inside a turn, so splitting at the marks reads the turns back exactly.
``examples`` explodes every assistant turn into an example of its own: all preceding turns and the
turn's opening mark are the prompt, the escaped reply is the target and alone trainable.

Offsets come from running sums over a window, so a long conversation costs time in proportion to its
length until prompts themselves are asked for. A prompt that no one selects is never made.

Defined results: a null text is empty; a null role is the empty role and not trainable; turns with
equal numbers follow role, then text, null numbers first; repeated rows are repeated turns; a
conversation without assistant turns gives no example; an empty table gives none; a null
conv_id is a conversation of its own. Columns other than the four are not read, so their names do
not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.llm.common import read

TRAINABLE = "assistant"
# The escape letters, in the order in which escaping must apply them.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, spans (start, n of each target; from 0, in code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    t = t.withColumn("open", F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))).withColumn("body", escape(F.col("text")))
    t = t.withColumn("segment", F.concat("open", "body", F.lit("</turn>")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("k", F.row_number().over(order))
    # the sum up to a row less its own part: a frame that stays running, whatever the length
    upto = F.sum(F.char_length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = t.withColumn("start", upto - F.char_length("segment") + F.char_length("open"))
    one = F.struct("k", "segment", F.when(F.col("role") == TRAINABLE, F.struct("start", F.char_length("body").alias("n"))).alias("span"))
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull())
    return whole.select("conv_id", F.array_join("t.segment", "").alias("formatted"), spans.alias("spans"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, prompt, target (escaped, as in ``formatted``), and the mask's span."""
    x = formatted.select("conv_id", "formatted", F.posexplode("spans").alias("example", "s"))
    start, n = F.col("s.start").cast("int"), F.col("s.n")
    return x.select("conv_id", "example", F.substring("formatted", F.lit(1), start).alias("prompt"), F.substring("formatted", start + 1, n).alias("target"), F.col("s.start").alias("loss_start"), n.alias("loss_n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, "</turn>", -1)
    real = F.slice(pieces, 1, F.size(pieces) - 1)
    body = lambda p: F.substring_index(p, ">", -1)
    head = lambda p: F.substring(F.substring_index(p, ">", 1), 7, 1 << 30)
    return F.transform(real, lambda p: F.struct(unescape(head(p)).alias("role"), unescape(body(p)).alias("text")))


#: The conversation that every run must bring back unharmed.
PROBE = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of turns and of trainable text, both read back from the formatted output; examples and characters of their prompts."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    formatted = format_chats(turns.unionByName(probe))
    ordered = F.array_sort(F.collect_list(F.struct("example", unescape(F.col("target")).alias("t"))))
    one = examples(formatted).select("conv_id", "example", "target", F.char_length("prompt").cast("long").alias("n"))
    loss = one.groupBy("conv_id").agg(F.array_join(ordered["t"], "").alias("loss"), F.count("*").alias("n_examples"), F.sum("n").alias("prompt_chars")).withColumnRenamed("conv_id", "c")
    back = formatted.withColumn("turns", parse(F.col("formatted")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    text = F.coalesce("loss", F.lit(""))
    joined = back.join(loss, back["conv_id"].eqNullSafe(loss["c"]), "left")
    return joined.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"), F.char_length(text).cast("long").alias("loss_chars"), F.sha2(text.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"), F.coalesce("prompt_chars", F.lit(0)).cast("long").alias("prompt_chars"))


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 14 AS n FROM t),
e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 16 AS prompt FROM l)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples, coalesce(sum(prompt) FILTER (role = 'assistant'), 0)::BIGINT AS prompt_chars
FROM e GROUP BY conv_id
"""
