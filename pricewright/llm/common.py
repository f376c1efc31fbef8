"""What the corpus operators share: the word pattern and shared-folder tables."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import spread_join  # noqa: F401
from ..sources.store import _LEFT, discard, materialize, scratch_path, scratch_tables, sweep  # noqa: F401

#: ASCII white space, and the words between: the contract's pattern [^\x20\x09-\x0D]+.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order, as array<string>."""
    return F.array_remove(F.split(text, BLANK_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    """How many words a text has, without building an array of them: every word
    and the blanks behind it become one character."""
    trimmed = F.ltrim(text, F.lit(BLANKS))
    return F.length(
        F.regexp_replace(trimmed, WORD_PATTERN + BLANK_CLASS + "*", "x")
    ).cast("long")


def shared(spark: SparkSession, value):
    """Broadcast ``value`` and return a function that gives it on executors. It is
    pickled with its class's code, so executors need not have this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


#: What separates word characters once A-Z are lower: the contract's [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
GAP_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alphanumeric_words(text: Column) -> Column:
    """The runs of ASCII letters, digits and non-ASCII characters of a text, A-Z
    lowered and nothing else, in order; none for a null text."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAP_CLASS + "+"), "")


def long_array(values) -> Column:
    """An array<bigint> constant. The optimizer folds it into one literal; as one
    string it reaches the JVM in one call."""
    return F.expr(f"CAST(split('{','.join(map(str, values))}', ',') AS ARRAY<BIGINT>)")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes, which has no
    function there: half a byte a step, the low half first."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    digit = f"substr(hex(encode({text})), CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END, 1)"
    halves = f"list_transform(range(length(hex(encode({text})))), lambda i: CAST(instr('0123456789ABCDEF', {digit}) - 1 AS BIGINT))"
    step = f"lambda c, h: xor(c >> 4, CAST({table} AS BIGINT[])[(xor(c, h) & 15) + 1])"
    return f"xor(list_reduce({halves}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
