"""Product family, form and produce role of a text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import is_in, let, lookup, mapping
from .lexicon import Lexicon
from .text import ATTACHED, strip_article, words


def _at(ws: Column, i: Column) -> Column:
    """The i-th word; null before the first and past the last."""
    return F.when(i >= 0, F.get(ws, F.greatest(i, F.lit(0))))


def _known(table: Column, word: Column) -> Column:
    """The table's value for a word, or for the word without its article."""
    return F.coalesce(lookup(table, word), lookup(table, strip_article(word)))


def family(text: Column, lexicon: Lexicon) -> Column:
    """The family that a name states, or null. The first word of a derived family
    wins; else the first of a base family; else the first produce word that no
    flavour marker stands beside."""
    tiers = lexicon.family_tiers()
    if not tiers:
        return F.lit(None).cast("string")
    tier = mapping({w: t for w, (t, _) in tiers.items()})
    name = mapping({w: f for w, (_, f) in tiers.items()})
    markers = [*lexicon.flavor_before, *lexicon.flavor_after]

    def of(ws):
        flavour = lambda i: is_in(_at(ws, i), markers)
        hits = F.transform(ws, lambda w, i: F.struct(_known(tier, w).alias("tier"), _known(name, w).alias("family"), (flavour(i - 1) | flavour(i + 1)).alias("flavour")))

        def first(hs, wanted):
            return F.get(F.filter(hs, lambda h: (h["tier"] == wanted) & ((h["tier"] != "produce") | ~h["flavour"])), F.lit(0))["family"]

        return let(hits, lambda hs: F.coalesce(first(hs, "derived"), first(hs, "base"), first(hs, "produce")))

    return let(words(text), of)


def offer_family(name: Column, name_ar: Column, category: Column, lexicon: Lexicon) -> Column:
    """A name's family, else the one that its category implies."""
    own = family(F.concat_ws(" ", name, name_ar), lexicon)
    return F.coalesce(own, lookup(mapping(lexicon.category_family), F.lower(category)))


def form(text: Column, lexicon: Lexicon) -> Column:
    """The first form (nuggets, fillet) that a text names, or null."""
    table = lexicon.type_words()
    if not table:
        return F.lit(None).cast("string")
    known = mapping(table)
    return F.get(F.filter(F.transform(words(text), lambda w: _known(known, w)), lambda t: t.isNotNull()), F.lit(0))


def is_processed(text: Column, lexicon: Lexicon) -> Column:
    """Whether a marker such as "frozen" occurs, articles and a leading waw aside."""
    bare = lambda w: F.regexp_replace(w, "^(وال|ال|و)", "")
    return F.exists(words(text), lambda w: is_in(w, lexicon.processed) | is_in(bare(w), lexicon.processed))


def is_produce(fam: Column, lexicon: Lexicon) -> Column:
    return is_in(fam, list(lexicon.produce))


def fresh_intent(query: Column, lexicon: Lexicon) -> Column:
    """The produce family that a query asks for fresh, or null."""
    fam = family(query, lexicon)
    plain = form(query, lexicon).isNull() & ~is_processed(query, lexicon)
    return F.when(is_produce(fam, lexicon) & plain, fam)


def produce_presence(text: Column, fam: Column, lexicon: Lexicon) -> Column:
    """How produce of a family occurs in a text: 'product', only as 'flavored', or
    null."""
    table = {w: f for f, ws in lexicon.produce.items() for w in ws}
    if not table:
        return F.lit(None).cast("string")
    known = mapping(table)
    markers = [*lexicon.flavor_before, *lexicon.flavor_after]

    def of(ws):
        flavour = lambda i: is_in(_at(ws, i), markers)
        named = lambda w: F.coalesce(lookup(known, w) == fam, F.lit(False))
        attached = lambda w: F.regexp_replace(w, ATTACHED, "")
        roles = F.transform(
            ws,
            lambda w, i: F.when(named(strip_article(w)), F.when(flavour(i - 1) | flavour(i + 1), "flavored").otherwise("product")).when(
                (attached(w) != w) & named(attached(w)), "flavored"
            ),
        )
        return let(roles, lambda r: F.when(F.array_contains(r, "product"), "product").when(F.array_contains(r, "flavored"), "flavored"))

    return let(words(text), of)
