"""Chat formatting with prefix-target expansion, in DataFrame operations only.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts every backslash and bar gets a backslash in front, in roles every newline
too. A control string holds a bar that follows ``<`` directly, so none is left
inside a turn, and removing one backslash before each escaped character gives
the text back.

Every assistant turn is the target of one example: all turns before it are its
context, its reply alone is under the loss mask. ``expand`` spells every example
out, context included, so the texts of a conversation together grow with the
square of its turns; they are made row by row behind the one shuffle and
``read_back`` takes what it needs of each where it is made, so no task holds
more than one of them. Beside its ``text`` an example has its own ``segment``
(what follows the previous target, up to its reply) and what its context is: the
segments before it, their turns and characters, and a checksum of them in their
order. ``read_back`` reads segments, masks and contexts from the whole examples
and fails where a context is not the example before it. Turns after the last
target are one more row without a loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column, role: bool = False) -> Column:
    """``c`` without control strings, null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\|\n])" if role else r"([\\|])", r"\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


#: Number, turns, characters and checksum of the segments before an example.
CONTEXT = ["segments", "turns", "chars", "checksum"]


def _context() -> Column:
    """``CONTEXT`` of a row among the rows (example, turns, segment) of its conversation."""
    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    parts = [F.count(F.lit(1)), F.sum("n_turns"), F.sum(F.length("segment").cast("long")), F.bit_xor(F.xxhash64("example", "segment"))]
    return F.struct(*[F.coalesce(x.over(before), F.lit(0)).cast("long").alias(c) for x, c in zip(parts, CONTEXT, strict=True)])


def expand(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text): conv_id, example, is_target, n_turns, text, segment, context, loss_start, loss_chars.

    text: the whole example, as it is trained on. context: a struct of ``CONTEXT``. loss_start and loss_chars count code points
    of the example, context included. Turns are ordered by turn (null first),
    then role and text; repeated rows are repeated turns; null role or text is
    empty; the rows without a conv_id are one conversation; an empty table gives
    no example; other columns, whatever their names, are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = F.concat(F.lit(START), escaped(F.col("role"), True), F.lit("\n"), escaped(F.col("text")), F.lit(f"{END}\n"))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    rows = rows.select("conv_id", "pos", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("target"), body.alias("body"))
    # The example of a turn: the number of targets before it.
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    named = rows.withColumn("example", F.coalesce(F.sum(F.col("target").cast("long")).over(before), F.lit(0)))
    parts = named.groupBy("conv_id", "example").agg(F.array_sort(F.collect_list(F.struct("pos", "target", "body"))).alias("ps"))
    last = F.element_at("ps", -1)
    segment = F.array_join(F.transform("ps", lambda p: p["body"]), "")
    head = F.regexp_extract(last["body"], r"(?s)^\Q<|im_start|>\E(?:[^\\\n]++|\\.)*+\n", 0)
    reply = F.length(last["body"]) - F.length(head) - len(END) - 1
    out = parts.select("conv_id", "example", last["target"].alias("is_target"), F.size("ps").cast("long").alias("n_turns"), segment.alias("segment"), reply.alias("reply"))
    upto = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({"context": _context(), "prefix": F.collect_list("segment").over(upto)})
    return out.select(
        "conv_id", "example", "is_target", "n_turns", F.array_join("prefix", "").alias("text"), "segment", "context",
        F.when(F.col("is_target"), F.col("context.chars") + F.length("segment") - len(END) - 1 - F.col("reply")).cast("long").alias("loss_start"),
        F.when(F.col("is_target"), F.col("reply")).otherwise(0).cast("long").alias("loss_chars"),
    )


def with_context(examples: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_chars of the targets."""
    return examples.where("is_target").select("conv_id", "example", "text", "loss_start", "loss_chars")


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples say of each conversation: the digests of turns and of the trained text.

    All is read from the texts of the whole examples: an example's own segment
    behind its context, the reply under its mask. Its context must be the text of
    the example before it, and be what it says; one that does not fit fails the
    job. expanded_chars: characters of all whole examples, contexts included;
    formatted_chars has each segment once.
    """
    chars = F.col("context.chars").cast("int")
    under = F.when(F.col("is_target"), unescaped(F.expr("substring(text, int(loss_start) + 1, int(loss_chars))"))).otherwise("")
    whole = F.when(F.col("is_target"), F.length("text")).otherwise(F.lit(0)).cast("long")
    parsed = examples.select(
        "conv_id", "example", F.col("context").alias("said"), F.col("text").substr(chars + 1, F.length("text")).alias("segment"), under.alias("loss"), whole.alias("whole"),
        F.xxhash64(F.col("text").substr(F.lit(1), chars)).alias("head"), F.xxhash64("text").alias("hash"),
    )
    parsed = parsed.withColumn("turns", F.slice(F.split("segment", r"\Q<|im_start|>\E"), 2, 2_000_000_000))
    # Whole texts go no further: the windows hold segments and hashes.
    order = Window.partitionBy("conv_id").orderBy("example")
    found = parsed.withColumn("n_turns", F.size("turns").cast("long")).withColumns({"found": _context(), "before": F.coalesce(F.lag("hash").over(order), F.xxhash64(F.lit("")))})
    wrong = F.raise_error(F.concat(F.lit("a context does not fit the segments before it: "), F.to_json("said"))).cast("long")
    whole = F.when((F.col("said") == F.col("found")) & (F.col("head") == F.col("before")), F.col("whole")).otherwise(wrong)
    role = lambda t: F.regexp_extract(t, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
    text = lambda t: F.substring(t, F.length(role(t)) + 2, F.length(t) - F.length(role(t)) - 2 - len(END))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(unescaped(role(t)), F.lit("\n"), unescaped(text(t)), F.lit("\n"))), "")
    each = found.select("conv_id", F.struct("example", lines.alias("lines"), "loss", F.col("n_turns").alias("n"), F.length("segment").alias("chars"), whole.alias("whole")).alias("e"))
    convs = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    joined = lambda f: F.array_join(F.transform("es", lambda e: e[f]), "")
    return convs.select(
        "conv_id",
        F.expr("aggregate(es, 0L, (a, e) -> a + e.n)").alias("n_turns"),
        F.sha2(joined("lines").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        F.expr("aggregate(es, 0L, (a, e) -> a + e.chars)").alias("formatted_chars"),
        F.expr("aggregate(es, 0L, (a, e) -> a + if(e.whole > 0, 1L, 0L))").alias("n_examples"),
        F.expr("aggregate(es, 0L, (a, e) -> a + e.whole)").alias("expanded_chars"),
    )


def op2_chat_prefix_targets(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = f"{END}{START}assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    return read_back(expand(turns.unionByName(extra)))


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, 24 + length(replace(replace(replace(r, '\\', '\\\\'), '|', '\\|'), chr(10), '\\' || chr(10)))
         + length(replace(replace(x, '\\', '\\\\'), '|', '\\|')) AS chars FROM t
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x ROWS UNBOUNDED PRECEDING) AS upto FROM f
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY turn NULLS FIRST, r, x), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  count(CASE WHEN r = 'assistant' THEN 1 END) AS n_examples,
  CAST(sum(CASE WHEN r = 'assistant' THEN upto ELSE 0 END) AS BIGINT) AS expanded_chars
FROM p GROUP BY conv_id
"""
