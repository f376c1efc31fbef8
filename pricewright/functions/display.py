"""Labels, states, messages and insight lines, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, lookup, mapping


def trimmed_number(x: Column, places: int = 2) -> Column:
    """Rounded, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", x), r"([.][0-9]*?)0+$", "$1"), r"[.]$", "")


def price_figure(x: Column) -> Column:
    """From 100 whole, under 0.1 three places, else two."""
    whole = F.format_string("%.0f", F.floor(x + 0.5).cast("double"))
    return F.when(x >= 100, whole).when(x < 0.1, trimmed_number(x, 3)).otherwise(trimmed_number(x))


def unit_price_label(value: Column, unit: Column) -> Column:
    """"6.25 SAR/L"; '' without a value. No third place for small values."""
    whole = F.format_string("%.0f", F.floor(value + 0.5).cast("double"))
    figure = F.when(value >= 100, whole).otherwise(trimmed_number(value))
    return F.coalesce(F.concat(figure, F.lit(" SAR/"), unit), F.lit(""))


def each_price_label(value: Column) -> Column:
    """"0.85 SAR each"; '' unless the value is finite and above 0."""
    good = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return F.when(good, F.concat(price_figure(value), F.lit(" SAR each"))).otherwise("")


def discount_share(old: Column, price: Column) -> Column:
    """The share that a price is under an earlier, higher one; else 0."""
    return F.coalesce(F.when(old > price, (old - price) / old), F.lit(0.0))


def match_badge(named_family: Column, band: Column, stage: Column) -> Column:
    """best, close or related: why a card stands where it does."""
    return F.when(named_family & (band <= 0), "related").when(stage >= 4, "best").when(stage == 3, "close").otherwise("related")


def enrichment_state(enriched: Column, model: Column) -> Column:
    return F.when(~F.coalesce(enriched, F.lit(False)), "missing").when(F.lower(model).contains("medium"), "medium").otherwise("enriched")


def family_category(family: Column, produce: list[str], categories: dict[str, str]) -> Column:
    """produce, the category that a family is mapped to, or general."""
    return F.when(F.coalesce(family.isin(*produce) if produce else F.lit(False), F.lit(False)), "produce").otherwise(
        F.coalesce(lookup(mapping(categories), family), F.lit("general"))
    )


def hue(text: Column) -> Column:
    """A colour's angle that hangs on the text alone."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(0), lambda h, c: (h * 31 + c) % 360)


def message(table: dict[str, dict[str, str]], key: Column, language: Column, values: dict[str, Column] | None = None, fallback: str = "en") -> Column:
    """The text of a key in a language, else in the fallback, else the key itself, with
    {name} replaced by its value."""
    known = {lang: mapping(texts) for lang, texts in table.items()}
    text = lookup(known[fallback], key)
    for lang, texts in known.items():
        if lang != fallback:
            text = F.when(language == lang, F.coalesce(lookup(texts, key), text)).otherwise(text)
    text = F.coalesce(text, key)
    for name, value in (values or {}).items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def counted_message(table: dict, key: Column, n: Column, language: Column) -> Column:
    """The message of key.one for 1 and of key.other for other numbers, with {n}."""
    form = F.concat(key, F.when(n == 1, ".one").otherwise(".other"))
    return message(table, form, language, {"n": n})


#: Lines shown at most, the shares (in percent) from which a price is
#: called above its low and a cut a big one, and badges shown at most.
LINES, ABOVE_LOW, BIG_CUT, BADGES = 3, 3, 30, 2


def insights(price: Column, old: Column, low: Column, trend: Column, days_left: Column) -> Column:
    """At most three lines, the most telling first: the lowest price or how many
    percent above it, a falling trend, the end of the offer, a big cut."""
    percent = F.floor((price - low) / low * 100 + 0.5)
    at_low = F.coalesce((low > 0) & (price - low <= 0.01), F.lit(False))
    cut = F.floor((old - price) / old * 100 + 0.5)
    lines = F.array(
        F.when(at_low, "lowest").when((low > 0) & (percent >= ABOVE_LOW), F.concat(F.lit("above-low:"), percent.cast("string"))),
        F.when((low > 0) & (trend == "down") & ~at_low, "falling"),
        F.when(days_left == 0, "ends-today").when(days_left == 1, "ends-tomorrow"),
        F.when((old > price) & (cut >= BIG_CUT), F.concat(F.lit("cut:"), cut.cast("string"))),
    )
    return F.slice(F.array_compact(lines), 1, LINES)


def badges(lowest_weeks: Column, drop: Column, rare: Column, multi: Column, ends_in: Column) -> Column:
    """At most two badges: what the history backs, what is advertised, then the rest."""
    found = F.array(
        F.when(lowest_weeks.isNotNull(), F.concat(F.lit("lowest:"), lowest_weeks.cast("string"))),
        F.when(drop > 0, F.concat(F.lit("drop:"), drop.cast("string"))),
        F.when(rare, "rare"),
        F.when(multi, "multi-buy"),
        F.when(ends_in == 0, "ends-today").when(ends_in == 1, "ends-tomorrow"),
    )
    return F.slice(F.array_compact(found), 1, BADGES)


def variant_for(unit: Column, total: Column, variants: Column) -> Column:
    """Of a product's history variants (unit, total, ...) in their order: that of its
    exact size, else the first within 25 % of it, else none; the first of all for a
    product without a size."""
    close = lambda v: (v["unit"] == unit) & (v["total"] > 0) & (F.abs(v["total"] - total) / total <= 0.25)
    exact = lambda v: (v["unit"] == unit) & (v["total"] == total)
    pick = lambda vs, rule: F.get(F.filter(vs, rule), F.lit(0))
    sized = unit.isNotNull() & (total > 0)
    return let(variants, lambda vs: F.when(F.coalesce(sized, F.lit(False)), F.coalesce(pick(vs, exact), pick(vs, close))).otherwise(F.get(vs, F.lit(0))))
