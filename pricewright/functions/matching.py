"""How well a product matches a query, as columns.

A query and a product are analysed once each, on their own side of a join
(``with_query``, ``with_item``); the match functions then take the two analyses, so
their expressions stay small however many of them one plan has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import family, form, fresh_intent
from .columns import is_in, let
from .lexicon import Lexicon
from .size import contradicts, parse_size, strip_sizes
from .text import ATTACHED, match_words, strip_article, tokens

#: Field tiers, least variant lengths, weights and demotion.
WHOLE, TEXT_PREFIX, WORD_START, INSIDE = 100, 80, 75, 45
LEAST_START, LEAST_INSIDE = 4, 5
BRAND_WEIGHT, COMPOUND = 0.6, 0.45


def variants(tokens_: Column, lexicon: Lexicon) -> Column:
    """Each token's words that mean the same, itself included."""
    table = lexicon.variants()
    if not table:
        return F.transform(tokens_, lambda t: F.array(t))
    flat = [x for w, group in table.items() for x in (F.lit(w), F.lit(" ".join(group)))]
    known = F.create_map(*flat)
    return F.transform(tokens_, lambda t: F.coalesce(F.split(F.try_element_at(known, t), " "), F.array(t)))


def with_query(queries: DataFrame, lexicon: Lexicon, query: str = "query") -> DataFrame:
    """+ ``q``: the query's tokens without its size (all, if nothing else is left),
    their variants, size, family, form and fresh produce family."""
    text = F.col(query)
    rows = queries.withColumn("_size", parse_size(text)).withColumn("_plain", tokens(text))
    bare = F.when(F.col("_size.unit").isNotNull(), tokens(strip_sizes(text)))
    rows = rows.withColumn("_bare", bare)
    rows = rows.withColumn("_tokens", F.when(F.coalesce(F.size("_bare"), F.lit(0)) > 0, F.col("_bare")).otherwise(F.col("_plain")))
    q = F.struct(
        F.col("_tokens").alias("tokens"),
        variants(F.col("_tokens"), lexicon).alias("variants"),
        F.col("_size").alias("size"),
        family(text, lexicon).alias("family"),
        form(text, lexicon).alias("form"),
        fresh_intent(text, lexicon).alias("fresh"),
    )
    return rows.withColumn("q", q).drop("_size", "_plain", "_bare", "_tokens")


def with_item(items: DataFrame, lexicon: Lexicon, name: str = "name", brand: str = "brand", size: str | None = None) -> DataFrame:
    """+ ``it``: words and text of name and brand, head word, size, family, form."""
    field = F.col(size) if size else None
    rows = items.withColumn("_w", match_words(F.col(name))).withColumn("_b", match_words(F.col(brand)))
    bare = F.transform("_w", strip_article)
    head = F.filter(bare, lambda w: (w != "") & ~w.rlike(r"^\d+$") & ~is_in(w, lexicon.head_skip))
    it = F.struct(
        F.col("_w").alias("words"),
        F.array_join("_w", " ").alias("text"),
        F.col("_b").alias("brand_words"),
        F.array_join("_b", " ").alias("brand_text"),
        F.coalesce(F.get(head, F.lit(0)), F.lit("")).alias("head"),
        parse_size(F.col(name), field).alias("size"),
        family(F.col(name), lexicon).alias("family"),
        form(F.col(name), lexicon).alias("form"),
    )
    return rows.withColumn("it", it).drop("_w", "_b")


def _starts_word(text: Column, v: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), text), F.concat(F.lit(" "), v))


def _tier(v: Column, ws: Column, text: Column) -> Column:
    """3 whole word, 2 word start, 1 inside, 0 none."""
    return (
        F.when(F.array_contains(ws, v), 3)
        .when((F.length(v) >= LEAST_START) & _starts_word(text, v), 2)
        .when((F.length(v) >= LEAST_INSIDE) & F.contains(text, v), 1)
        .otherwise(0)
    )


def _points(v: Column, ws: Column, text: Column) -> Column:
    return (
        F.when(F.array_contains(ws, v), WHOLE)
        .when((F.length(v) >= LEAST_START) & text.startswith(v), TEXT_PREFIX)
        .when((F.length(v) >= LEAST_START) & _starts_word(text, v), WORD_START)
        .when((F.length(v) >= LEAST_INSIDE) & F.contains(text, v), INSIDE)
        .otherwise(0)
    )


def _best(q: Column, of, ws: Column, text: Column) -> Column:
    """Per query token the best of its variants."""
    return F.transform(q["variants"], lambda vs: F.coalesce(F.array_max(F.transform(vs, lambda v: of(v, ws, text))), F.lit(0)))


def token_tiers(q: Column, it: Column) -> Column:
    """Per query token its best tier in name or brand."""
    name = _best(q, _tier, it["words"], it["text"])
    brand = _best(q, _tier, it["brand_words"], it["brand_text"])
    return F.zip_with(name, brand, lambda a, b: F.greatest(a, b))


def coverage(q: Column, it: Column) -> Column:
    """The share of query tokens found in name or brand; 1 for an empty query."""
    n = F.size(q["tokens"])
    hit = F.size(F.filter(token_tiers(q, it), lambda t: t > 0))
    return F.when(n == 0, 1.0).otherwise(hit / F.greatest(n, F.lit(1)))


def covered_tokens(q: Column, it: Column) -> Column:
    """Positions of the query tokens found in name or brand."""
    marked = F.transform(token_tiers(q, it), lambda t, i: F.when(t > 0, i))
    return F.filter(marked, lambda i: i.isNotNull())


def covers_enough(q: Column, it: Column) -> Column:
    """One token: always; two: both; more: all but one."""
    n = F.size(q["tokens"])
    least = F.when(n == 2, 1.0).otherwise((n - 1) / n)
    return (n < 2) | (coverage(q, it) >= least)


def _score(points: Column) -> Column:
    def of(ps):
        n = F.greatest(F.size(ps), F.lit(1))
        total = F.aggregate(ps, F.lit(0), lambda a, p: a + p)
        hit = F.size(F.filter(ps, lambda p: p > 0))
        return total / n * (0.5 + 0.5 * hit / n)

    return let(points, of)


def is_shifted(q: Column, it: Column, lexicon: Lexicon) -> Column:
    """Whether a query word is followed by one that makes it another product."""
    ws = it["words"]
    shifted = F.array_compact(F.transform(ws, lambda w, i: F.when(is_in(F.get(ws, i + 1), lexicon.shifters), w)))
    return F.arrays_overlap(shifted, F.flatten(q["variants"]))


def relevance(q: Column, it: Column, lexicon: Lexicon) -> Column:
    """0 to 100: name, or brand at less weight; demoted if a query word is followed
    by one that shifts the product."""
    ws = it["words"]
    penalty = F.when(is_shifted(q, it, lexicon), COMPOUND).otherwise(1.0)
    name = _score(_best(q, _points, ws, it["text"]))
    brand = _score(_best(q, _points, it["brand_words"], it["brand_text"])) * BRAND_WEIGHT
    return F.greatest(name, brand) * penalty


def is_relevant(q: Column, it: Column) -> Column:
    """Whether the name has a query word, or a word that begins with one, or the
    first one inside; true for an empty query."""
    tiers = _best(q, _tier, it["words"], it["text"])
    return (F.size(q["tokens"]) == 0) | let(
        tiers, lambda ts: F.exists(ts, lambda t: t >= 2) | F.coalesce(F.get(ts, F.lit(0)) >= 1, F.lit(False))
    )


def is_primary(q: Column, it: Column) -> Column:
    return F.when(F.size(q["tokens"]) < 2, is_relevant(q, it)).otherwise(covers_enough(q, it))


def presence(q: Column, it: Column, lexicon: Lexicon) -> Column:
    """The first query token in a name: 'primary' as the product, 'secondary' only
    as flavour or ingredient, or null."""
    ws, vs = it["words"], F.get(q["variants"], F.lit(0))
    at = lambda i: F.when(i >= 0, F.get(ws, F.greatest(i, F.lit(0))))
    own = lambda w: F.array_contains(vs, w) | F.array_contains(vs, strip_article(w))
    after = [*lexicon.flavor_after, *lexicon.shifters]
    aside = lambda i: is_in(at(i - 1), lexicon.flavor_before) | is_in(at(i + 1), after)
    bare = lambda w: F.regexp_replace(w, ATTACHED, "")
    inside = lambda w: (bare(w) != w) & (F.array_contains(vs, bare(w)) | F.array_contains(vs, F.regexp_replace(bare(w), "^ال", "")))
    roles = F.transform(
        ws, lambda w, i: F.when(own(w), F.when(aside(i), "secondary").otherwise("primary")).when(inside(w), "secondary")
    )
    return let(
        roles,
        lambda rs: F.when(F.array_contains(rs, "primary"), "primary").when(F.array_contains(rs, "secondary"), "secondary"),
    )


def has_phrase(q: Column, it: Column) -> Column:
    """Whether the query tokens stand in the name one after the other."""
    ws, vs = it["words"], q["variants"]
    fits = lambda w, v: F.coalesce(F.array_contains(v, w) | F.array_contains(v, strip_article(w)), F.lit(False))
    starts = F.when(F.size(ws) >= F.size(vs), F.sequence(F.lit(0), F.size(ws) - F.size(vs)))
    found = F.exists(starts, lambda s: F.forall(F.transform(vs, lambda v, k: fits(F.get(ws, s + k), v)), lambda x: x))
    return F.coalesce(found, F.lit(False))


def match_stage(q: Column, it: Column, lexicon: Lexicon) -> Column:
    """0 to 5: how a product answers a query. A size that contradicts the query's
    caps the stage at 1."""
    n = F.size(q["tokens"])
    other = F.coalesce(q["family"] != it["family"], F.lit(False))
    headed = F.coalesce(F.array_contains(F.get(q["variants"], F.lit(0)), it["head"]), F.lit(False))

    def single(t):
        return let(
            F.coalesce(presence(q, it, lexicon), F.lit("none")),
            lambda role: F.when(role == "secondary", 1)
            .when((t == 0) & (role == "none"), 0)
            .when(other, 1)
            .when((role != "primary") & (t < 2), 2)
            .when(headed, 5)
            .otherwise(4),
        )

    def many(ts):
        count = lambda least: F.size(F.filter(ts, lambda t: t >= least))
        return (
            F.when(count(1) < n, F.when(count(1) >= n - 1, 1).otherwise(0))
            .when(other, 1)
            .when(has_phrase(q, it), 5)
            .when(count(3) == n, 4)
            .when(count(2) == n, 3)
            .otherwise(2)
        )

    raw = let(token_tiers(q, it), lambda ts: F.when(n == 1, single(F.get(ts, F.lit(0)))).otherwise(many(ts)))
    capped = let(raw, lambda r: F.when(contradicts(it["size"], q["size"]), F.least(r, F.lit(1))).otherwise(r))
    return F.when(n == 0, 0).otherwise(capped)


def stage_band(stage: Column, several: Column, one_word_band: str = "exact") -> Column:
    """Stages that compete: of several words all from 2 up, of one word 4 and 5
    where the band is 'primary'."""
    single = F.when(stage >= 4, 4).otherwise(stage) if one_word_band == "primary" else stage
    return F.when(several, F.when(stage >= 2, 2).otherwise(stage)).otherwise(single)
