"""Rows that every document operator must take: nulls, empty and very long texts,
repeats, and further columns whose names operators use themselves."""

EXTRA = ["h", "size", "fp", "token", "p", "n", "_id", "sid", "payload", "evidence", "key", "gid"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in EXTRA)

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions beside an old mill"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(12_000))

TEXTS = [
    (0, PROSE, "en", "a"),
    (0, PROSE, "en", "a"),  # a repeated row
    (1, PROSE, "en", "a"),  # an equal text
    (2, PROSE.upper(), "en", None),
    (3, PROSE + " today", "en", "b"),
    (4, None, "en", "b"),
    (5, "", None, "b"),
    (6, " \t\n\x0b\x0c\r ", "en", "c"),
    (7, LONG, "en", "c"),
    (8, "a b c", None, None),
    (9, "12 34 !!", "de", "c"),
    (10, "éàü ñ ß 漢字 \u00a0 x\u2003y 🙂", "fr", "c"),
    (None, "no id here", "en", "a"),
    (11, "x" * 70_000, "en", "a"),
    (12, "nul\x00byte and <|endoftext|> token", "en", "a"),
]


def odd_documents(spark):
    rows = [(i, t, lang, s, len(t or "")) + tuple(range(len(EXTRA))) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
