"""Text normalization and tokens, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# Arabic marks that carry no identity, and letters folded together.
MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
FOLD_FROM = "أإآٱىؤئةیک"
FOLD_TO = "اااايويهيك"
ARTICLE = "^(وال|ال)"
ATTACHED = "^(بال|لل)"


def normalize(text: Column) -> Column:
    """Lower case, marks removed, letter forms folded, all but letters, digits and
    blanks to blanks, blanks collapsed and trimmed. Null gives ''."""
    t = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    t = F.translate(F.regexp_replace(t, MARKS, ""), FOLD_FROM, FOLD_TO)
    t = F.regexp_replace(t, r"(?U)[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def folded(words) -> list[str]:
    """Dictionary words with their letter forms folded, each once, in order."""
    return list(dict.fromkeys(w.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)) for w in words))


def strip_article(word: Column) -> Column:
    return F.regexp_replace(word, ARTICLE, "")


def canonical_word(word: Column) -> Column:
    """A normalized word without its article, unless under two letters are left."""
    bare = strip_article(word)
    return F.when(F.length(bare) >= 2, bare).otherwise(word)


def words(text: Column) -> Column:
    """The normalized words of a text."""
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def match_words(text: Column) -> Column:
    """The normalized words without articles."""
    return F.transform(words(text), canonical_word)


def match_text(text: Column) -> Column:
    return F.array_join(match_words(text), " ")


def is_token(word: Column) -> Column:
    return (F.length(word) > 1) | word.rlike(r"\p{N}")


def tokens(text: Column) -> Column:
    """Words of two letters or more, or with a digit."""
    return F.filter(match_words(text), is_token)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays; null if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.try_divide(shared.cast("double"), F.size(F.array_union(a, b)).cast("double"))


def present_case(text: Column) -> Column:
    """Title case, unless the text mixes cases on purpose."""
    mixed = text.rlike(r"\p{Ll}") & text.rlike(r"\p{Lu}")
    return F.when(mixed, text).otherwise(F.initcap(text))


def leading_words(text: Column, count: int, chars: int) -> Column:
    """The first words of a text, cut to so many characters."""
    some = F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), 1, count)
    return F.substring(F.array_join(some, " "), 1, chars)


def history_query(name: Column, category: Column) -> Column:
    """The first three words longer than two letters that no digit leads; else the
    category."""
    long = F.filter(F.split(F.trim(name), r"\s+"), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d"))
    return F.coalesce(F.nullif(F.array_join(F.slice(long, 1, 3), " "), F.lit("")), category)


def trim_debris(name: Column, debris) -> Column:
    """Drop leading words that are debris or begin with a digit; the whole name
    stays if nothing else would."""

    def of(parts):
        good = F.filter(F.transform(parts, lambda w, i: F.when(~(F.lower(w).isin(*debris) | w.rlike(r"^\d")), i + 1)), lambda i: i.isNotNull())
        first = F.get(good, F.lit(0))
        return F.when(first.isNotNull(), F.array_join(F.slice(parts, F.coalesce(first, F.lit(1)), F.size(parts)), " ")).otherwise(name)

    return let(F.split(F.trim(name), r"\s+"), of)
