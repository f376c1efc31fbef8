"""Conversation structure repair by the cheapest edits.

A repaired conversation's roles follow the grammar ``(s?(ua)+)?``. A row is kept, given
the role that the grammar waits for, or deleted; turns without text may be inserted
anywhere. Costs to go are computed backwards: before each row, the least cost from each
state of the grammar to a good end. A forward walk then takes, among the edits whose
cost is just the difference of two costs to go, the least letter; in one state a letter
leads to one state only, so the walk's letters are the least of the cheapest.

One shuffle brings a conversation's rows together. Both directions then read them in
sorted order and keep a few numbers, whatever a conversation's length: the costs are
written beside the rows on the way back, and rows are turned to edits, and edits to
digests, as they come on the way forth. A conversation is one task's work, since its
digest is one stream of its text.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, crc32_sql

KEEP, REROLE, DELETE, INSERT, TRUNCATED_KEPT = 0, 1, 2, 5, 5
#: A row's first fault.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after s, after u, after a. What a role's initial leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a state waits for, which edits can give, and its state.
WANTED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
GOOD_END = (0, 3)
#: Costs to go behind the last row.
END = (0, 2 * INSERT, INSERT, 0)


def row_edits(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """The edits that take a row away in a state, as (letter, cost, next state)."""
    found = [("D", DELETE, state)]
    if fault in (NONE, TRUNCATED):
        extra = TRUNCATED_KEPT if fault == TRUNCATED else 0
        if initial in NEXT[state]:
            found.append(("K", KEEP + extra, NEXT[state][initial]))
        found.append(("R", REROLE + extra, WANTED[state][1]))
    return found


def costs_before(initial: str, fault: int, after: tuple) -> tuple:
    """Costs to go before a row from those behind it, for each state."""
    best = [min(c + after[q] for _, c, q in row_edits(initial, fault, state)) for state in range(4)]
    for _ in range(4):  # insertions may follow each other
        best = [min(c, INSERT + best[WANTED[state][1]]) for state, c in enumerate(best)]
    return tuple(best)


class Costs:
    """``costs_before`` remembered by differences: costs of states differ by at most
    two insertions, so few cases exist."""

    def __init__(self):
        self.known = {}

    def before(self, initial: str, fault: int, after: tuple) -> tuple:
        low = min(after)
        key = (initial, fault, *(c - low for c in after))
        if key not in self.known:
            self.known[key] = costs_before(initial, fault, key[2:])
        return tuple(c + low for c in self.known[key])


def _known(initial: str) -> str:
    return initial if initial in ("s", "u", "a") else ""


def _backward(batches):
    """Rows, last first, with the costs to go behind each."""
    costs, conv, after = Costs(), object(), END
    for batch in batches:
        column = []
        for own, initial, fault in zip(batch["conv_id"].to_pylist(), batch["initial"].to_pylist(), batch["fault"].to_pylist(), strict=True):
            if own != conv:
                conv, after = own, END
            column.append(after)
            after = costs.before(_known(initial), fault, after)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, pa.list_(pa.int64()))], names=[*batch.schema.names, "after"])


def _walk(batches):
    """Rows in order -> edits in order: (conv_id, letter, role, text, row), where row
    is (turn, initial, fault) or None for an insertion; deleted rows keep theirs."""
    costs, conv, state, began = Costs(), None, 0, False

    def end():
        nonlocal state
        while began and state not in GOOD_END:
            role, state = WANTED[state]
            yield conv, "I", role, "", None

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "initial", "fault", "after")]
        for own, turn, role, text, initial, fault, after in zip(*columns, strict=True):
            if not began or own != conv:
                yield from end()
                conv, state, began = own, 0, True
            after = tuple(after)
            before = costs.before(_known(initial), fault, after)
            while True:
                edits = [e for e in row_edits(_known(initial), fault, state) if e[1] + after[e[2]] == before[state]]
                inserted, to = WANTED[state]
                if INSERT + before[to] == before[state] and all(e[0] > "I" for e in edits):
                    yield own, "I", inserted, "", None
                    state = to
                    continue
                letter, _, to = min(edits)
                yield own, letter, inserted if letter == "R" else role, text, (turn, initial, fault)
                state = to
                break
    yield from end()


def _in_batches(rows, names, types, size=4096):
    """Tuples as record batches."""
    held = []

    def batch():
        made = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays(made, names=names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
    if held:
        yield batch()


def _digests(edits):
    """One row per conversation: counts of its rows, cost, letters, digest."""
    conv, counts, digest, letters, last = None, None, None, None, None

    def row():
        gaps = counts["high"] - counts["low"] + 1 - counts["turns"] if counts["turns"] else 0
        return (conv, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], counts["illegal"], counts["cost"], "".join(letters), digest.hexdigest())

    for own, letter, role, text, source in edits:
        if counts is None or own != conv:
            if counts is not None:
                yield row()
            conv, digest, letters, last = own, sha256(), [], None
            counts = dict.fromkeys((NONE, BLANK, DUPLICATE, TRUNCATED, "illegal", "cost", "turns", "low", "high", "kept"), 0)
        letters.append(letter)
        counts["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
        if source is not None:
            turn, initial, fault = source
            counts[fault] += 1
            counts["cost"] += TRUNCATED_KEPT if fault == TRUNCATED and letter != "D" else 0
            counts["illegal"] += last is not None and last + initial not in ("su", "ua", "au")
            last = initial
            if turn is not None and (not counts["turns"] or turn != counts["high"]):
                counts["low"] = counts["low"] if counts["turns"] else turn
                counts["high"] = turn
                counts["turns"] += 1
        if letter != "D":
            digest.update(f"{chr(10) if counts['kept'] else ''}{role}:{text}".encode())
            counts["kept"] += 1
    if counts is not None:
        yield row()


def _prepared(turns: DataFrame) -> DataFrame:
    """Rows of each conversation in one task and in order, with initial, fault and the
    costs to go behind each. Ties of a turn are ordered by role and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
    ).repartition("conv_id")
    told = F.rtrim("text", F.lit(BLANKS))
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(told == "", BLANK)
        .when(F.col("again") > 1, DUPLICATE)
        .when(~F.substring(told, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )
    rows = rows.withColumn("again", F.row_number().over(seen)).withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    back = rows.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("again"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", after array<bigint>"
    costed = back.mapInArrow(_backward, schema)
    return costed.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")


def repair_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> one row per edit: conv_id, seq (from 0, by
    conversation), edit (K, R, D, I), role and text as repaired (of a deleted row, its
    own), turn and fault (0 none, 1 blank, 2 duplicate, 3 truncated; null for an
    insertion). The rows but those of edit D, by seq, are the repaired conversation.

    Rows are taken by turn, nulls first; those of one turn by role, then text. Null
    texts are blank, null roles an empty role, which no grammar takes: such rows are
    deleted or given a role. Rows without conv_id are one conversation. Repeated rows
    are duplicates. Very long texts and conversations are streamed. An empty table
    gives no rows. Further columns are ignored.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def edits(batches):
        def numbered():
            conv, seq = object(), 0
            for own, letter, role, text, row in _walk(batches):
                conv, seq = own, seq + 1 if own == conv else 0
                turn, _, fault = row or (None, None, None)
                yield own, seq, letter, role, text, turn, fault

        types = [arrow_id, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        yield from _in_batches(numbered(), ["conv_id", "seq", "edit", "role", "text", "turn", "fault"], types)

    arrow_id = _arrow_type(kind)
    return _prepared(turns).mapInArrow(edits, f"conv_id {kind}, seq bigint, edit string, role string, text string, turn bigint, fault int")


def repair_digests(turns: DataFrame) -> DataFrame:
    """``repair_turns`` folded into one row per conversation as it streams: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows as
    there; conversations without a row are none."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    arrow_id = _arrow_type(kind)

    def digests(batches):
        types = [arrow_id, *[pa.int64()] * 6, pa.string(), pa.string()]
        yield from _in_batches(_digests(_walk(batches)), names, types)

    return _prepared(turns).mapInArrow(digests, f"conv_id {kind}, {', '.join(f'{n} bigint' for n in names[1:7])}, audit string, repaired_sha256 string")


def _arrow_type(kind: str):
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage, by the crc32 of ``conv_id:turn`` modulo 20: drop (0),
    empty the text (1), remove its end marks (2), repeat (3), make it the user's (4)."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1))
    return (
        turns.withColumns({"case": case, "role": F.when(case == 4, "user").otherwise(role)})
        .filter("case <> 0")
        .withColumn("text", F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy"))
        .drop("copy")
    )


def op13(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair_digests(damage(rows)).withColumnRenamed("conv_id", "own")
    every = rows.select("conv_id").distinct()
    nothing = sha256(b"").hexdigest()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def op13_sql() -> str:
    """The same costs as text: nine digits of cost, the letters, chr(1), the repaired
    turns. The least of such texts is the least cost and then the least letters."""

    def prepend(rest: str, cost: str, letter: str, turn: str | None = None) -> str:
        tail = f"substr({rest}, 10)"
        kept = f"split_part({tail}, chr(1), 1)"
        said = f"substr({tail}, length({kept}) + 2)"
        if turn:
            said = f"({turn}) || CASE WHEN {said} = '' THEN '' ELSE chr(10) || {said} END"
        return f"printf('%09d', CAST(substr({rest}, 1, 9) AS INTEGER) + {cost}) || '{letter}' || {kept} || chr(1) || {said}"

    def consumed(state: int) -> str:
        role, to = WANTED[state]
        options = [prepend(f"v{state}", str(DELETE), "D")]
        for initial, after in NEXT[state].items():
            options.append(f"CASE WHEN fault IN (0, 3) AND initial = '{initial}' THEN {prepend(f'v{after}', 'extra', 'K', 'role || chr(58) || text')} END")
        options.append(f"CASE WHEN fault IN (0, 3) THEN {prepend(f'v{to}', f'{REROLE} + extra', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END")
        return f"least({', '.join(options)})"

    def inserted(state: int, rest: str) -> str:
        return prepend(rest, str(INSERT), "I", f"'{WANTED[state][0]}:'")

    end = {0: "'000000000' || chr(1)", 3: "'000000000' || chr(1)"}
    end[2] = "'000000005I' || chr(1) || 'assistant:'"
    end[1] = "'000000010II' || chr(1) || 'user:' || chr(10) || 'assistant:'"
    name = "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"
    return rf"""
WITH RECURSIVE cases AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(name)} % 20 AS c FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) AS copy
  FROM cases WHERE c <> 0),
repeated AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM damaged),
judged AS (
  SELECT *, CASE WHEN rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 1 WHEN again > 1 THEN 2
                 WHEN substr(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), -1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         substr(role, 1, 1) AS initial,
         row_number() OVER w AS n, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair,
         dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv
  FROM repeated WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
counted AS (
  SELECT conv, any_value(conv_id) AS conv_id, CAST(max(n) AS BIGINT) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv),
togo AS (
  SELECT conv, n, {end[0]} AS v0, {end[1]} AS v1, {end[2]} AS v2, {end[3]} AS v3 FROM counted
  UNION ALL
  SELECT conv, n - 1, least(b0, {inserted(0, "i2")}), least(b1, {inserted(1, "i2")}), i2, i3
  FROM (
    SELECT *, least(b2, {inserted(2, "b3")}) AS i2, least(b3, {inserted(3, "b2")}) AS i3
    FROM (
      SELECT t.conv, t.n, {consumed(0)} AS b0, {consumed(1)} AS b1, {consumed(2)} AS b2, {consumed(3)} AS b3
      FROM togo t JOIN (SELECT *, CASE WHEN fault = 3 THEN {TRUNCATED_KEPT} ELSE 0 END AS extra FROM judged) r ON r.conv = t.conv AND r.n = t.n))),
done AS (
  SELECT c.*, CAST(substr(v0, 1, 9) AS BIGINT) AS cost, split_part(substr(v0, 10), chr(1), 1) AS audit,
         substr(v0, 11 + length(split_part(substr(v0, 10), chr(1), 1))) AS said
  FROM counted c JOIN togo t ON t.conv = c.conv AND t.n = 0)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN done d ON e.conv_id IS NOT DISTINCT FROM d.conv_id
"""
