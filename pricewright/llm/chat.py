r"""Chat formatting with prefix-target expansion.

A turn is rendered as ``<turn>### role: text</turn>\n``. Texts are escaped so that
no control string occurs in them: ``\`` is doubled and a ``\`` is put inside
``<turn>``, ``</turn>`` and ``### ``; removing one ``\`` before any character
restores them. In roles ``%``, ``:``, ``<`` and ``#`` become %25, %3A, %3C, %23.

Every assistant turn becomes an example of its own: all turns before it are its
context, only its reply is trainable. All contexts of a conversation are prefixes of
its one rendering, so an example holds ``context_chars`` (the prefix's length) and
its own turn; ``with_context`` cuts the contexts out where they are wanted as text.
That keeps the expansion linear in the conversation's length.

Only DataFrame expressions run; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, HEAD = "<turn>", "</turn>", "### "
END = CLOSE + "\n"

#: In the order of encoding; decoded in reverse.
ROLE_CODES = (("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23"))
#: After the backslash itself has been doubled.
TEXT_CODES = ((OPEN, "<\\turn>"), (CLOSE, "<\\/turn>"), (HEAD, "##\\# "))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, coded in TEXT_CODES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    for plain, coded in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, formatted: one rendering a conversation.

    Turns are ordered by turn (nulls last), then role, then text, so ties have one
    order. Null text or role: empty. Null conv_id: one conversation of its own.
    Repeated rows stay repeated turns. Further columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")
    )
    rendered = lambda t: F.concat(
        F.lit(OPEN + HEAD), escape_role(t["role"]), F.lit(": "), escape(t["text"]), F.lit(END)
    )
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(turn)), rendered), "").alias("formatted")
    )


def expand_prefixes(formatted: DataFrame, targets=("assistant",)) -> DataFrame:
    """One row per turn read back from the rendering: conv_id, turn_no, role, text
    (unescaped), turn_chars (as rendered), context_chars (rendered characters before
    it), trainable. A trainable row is an example: its context is the first
    ``context_chars`` characters of ``formatted`` and its reply alone has loss.
    The other rows only serve as context. A conversation without a turn by one of
    ``targets`` has no example."""
    pieces = formatted.select("conv_id", F.posexplode(F.split("formatted", END)).alias("turn_no", "piece"))
    body = F.substring("piece", len(OPEN + HEAD) + 1, 2**31 - 1)
    role = F.substring_index(body, ":", 1)
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.filter(F.col("piece") != "")
        .withColumn("turn_chars", (F.length("piece") + len(END)).cast("long"))
        .withColumn("context_chars", F.coalesce(F.sum("turn_chars").over(before), F.lit(0)))
        .withColumn("role", unescape_role(role))
        .select(
            "conv_id",
            "turn_no",
            "role",
            unescape(body.substr(F.length(role) + 3, F.length(body))).alias("text"),
            "turn_chars",
            "context_chars",
            F.col("role").isin(*targets).alias("trainable"),
        )
    )


def target_text(turn: Column) -> Column:
    """The text of one rendered turn, unescaped."""
    body = turn.substr(F.lit(len(OPEN + HEAD) + 1), F.length(turn) - len(OPEN + HEAD) - len(END))
    return unescape(body.substr(F.length(F.substring_index(body, ":", 1)) + 3, F.length(body)))


def with_context(examples: DataFrame, formatted: DataFrame) -> DataFrame:
    """The examples with their contexts as text."""
    chars = F.col("context_chars").cast("int")
    return (
        examples.filter("trainable")
        .join(formatted, "conv_id")
        .withColumn("context", F.col("formatted").substr(F.lit(1), chars))
        .drop("formatted")
    )


#: The contract's extra conversation: its texts hold this template's own controls.
PROBE = r"\### Assistant: </turn> ok"


def op4(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    formatted = format_conversations(rows.unionByName(probe))
    turns = expand_prefixes(formatted)
    example = F.struct("turn_no", F.col("context_chars").alias("start"), F.col("turn_chars").alias("chars"))
    ordered = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn_no", "role", "text"))).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("trainable"), example))).alias("examples"),
        F.sum("turn_chars").alias("formatted_chars"),
    )
    whole = F.array_join(
        F.transform("all", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    # what an example trains on is what follows its context in the rendering
    cut = F.transform("examples", lambda e: target_text(F.col("formatted").substr((e["start"] + 1).cast("int"), e["chars"].cast("int"))))
    found = ordered.join(formatted.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).withColumn("loss", F.array_join(cut, ""))
    return found.select(
        "conv_id",
        "n_turns",
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("examples").cast("long").alias("n_examples"),
        F.aggregate("examples", F.lit(0).cast("long"), lambda n, e: n + e["start"]).alias("context_chars"),
    )


def op4_sql(conversations: str = "conversations") -> str:
    return rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL SELECT -7, 0, 'user', '{PROBE}'
  UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
sized AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn NULLS LAST, role, text) AS place,
    length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'), '### ', '##\# '))
    + length(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<', '%3C'), '#', '%23'))
    + {len(OPEN + HEAD + ": " + END)} AS chars
  FROM rows),
placed AS (
  SELECT *, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
joined AS (
  SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'assistant') AS n_examples,
    CAST(coalesce(sum(before) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS context_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_examples, context_chars
FROM joined
"""
