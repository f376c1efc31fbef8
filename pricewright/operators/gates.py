"""The gate ladder: which candidates are the product that a query asks for.

Gates apply in order, each to what the one before kept: match stage, family, form,
fresh produce. What a gate drops is counted. In a never-empty policy a gate that
would drop all is not applied.

A verdict depends on a candidate's profile only: band, family, form and whether it is
plain produce. Candidates are counted per query and profile, with partial sums before
the shuffle; the gates are windows over these few counts, and their verdicts are joined
back. So a popular query's candidates never meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, matching
from ..functions.lexicon import Lexicon
from ..sources.store import materialize
from .resolve import spread_join


@dataclass(frozen=True)
class Policy:
    one_word_band: str
    infer_family: bool
    never_empty: bool


POLICIES = {
    "summary": Policy("exact", True, True),
    "alert": Policy("exact", True, False),
    "history": Policy("primary", False, True),
}


def interpret(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows with the analyses ``q`` and ``it`` -> + stage, family, form."""
    q, it = F.col("q"), F.col("it")
    return rows.withColumns(
        {"stage": matching.match_stage(q, it, lexicon), "family": it["family"], "form": it["form"]}
    )


#: What tells candidates apart for the gates.
PROFILE = ["_band", "family", "form", "_plain"]


def _gate(rows: DataFrame, label: str, passes: Column, policy: Policy, per: str) -> DataFrame:
    """Mark in ``dropped_by`` the profiles still in that a gate drops. ``passes`` is
    null where the gate does not apply to the query."""
    rows = rows.withColumn("_in", F.col("dropped_by").isNull()).withColumn("_pass", F.coalesce(passes, F.lit(True)))
    survivors = F.max(F.col("_in") & F.col("_pass")).over(Window.partitionBy(per))
    applied = survivors if policy.never_empty else F.lit(True)
    drop = F.col("_in") & ~F.col("_pass") & applied
    return rows.withColumn("dropped_by", F.when(drop, F.lit(label)).otherwise(F.col("dropped_by"))).drop("_in", "_pass")


def _verdicts(profiles: DataFrame, policy: Policy, per: str) -> DataFrame:
    """Profiles (with n, first, q_family, q_form, q_fresh) -> + target_family,
    dropped_by."""
    window = Window.partitionBy(per)
    rows = profiles.withColumn("dropped_by", F.when(F.col("_band") < F.max("_band").over(window), "stage").cast("string"))
    target = F.col("q_family")
    if policy.infer_family:
        inside = F.col("dropped_by").isNull() & F.col("family").isNotNull()
        alike = Window.partitionBy(per, "family")
        rows = rows.withColumns(
            {"_n": F.sum(F.when(inside, F.col("n"))).over(alike), "_first": F.min(F.when(inside, F.col("first"))).over(alike)}
        )
        rows = rows.withColumns(
            {
                "_known": F.sum(F.when(inside, F.col("n"))).over(window),
                "_most": F.max(F.when(inside, F.struct("_n", (-F.col("_first")).alias("o"), "family"))).over(window),
            }
        )
        strong = (F.col("_most._n") >= 2) & (F.col("_most._n") * 2 > F.col("_known"))
        target = F.coalesce(target, F.when(strong, F.col("_most.family")))
    rows = rows.withColumn("target_family", target)
    fits = F.col("family").isNull() | (F.col("family") == F.col("target_family"))
    rows = _gate(rows, "family", fits, policy, per)
    wanted = F.col("q_form")
    rows = _gate(rows, "form", F.when(wanted.isNotNull(), F.col("form").isNull() | (F.col("form") == wanted)), policy, per)
    fresh = F.col("q_fresh")
    asked = fresh.isNotNull() & (F.col("target_family").isNull() | (F.col("target_family") == fresh))
    return _gate(rows, "fresh", F.when(asked, F.col("_plain")), policy, per)


def gate_ladder(candidates: DataFrame, lexicon: Lexicon, tier: str = "summary", per: str = "query_id") -> DataFrame:
    """Interpreted candidates -> + target_family, dropped_by (null: kept, else
    stage, family, form or fresh). Needs query_id, q, name, stage, family, form, ord.

    Ties for the commonest family go to the one whose first candidate (by ``ord``)
    comes first.
    """
    policy = POLICIES[tier]
    role = F.coalesce(classify.produce_presence(F.col("name"), F.col("q.fresh"), lexicon), F.lit("none"))
    plain = F.col("form").isNull() & ~classify.is_processed(F.col("name"), lexicon) & (role != "flavored")
    rows = candidates.withColumns(
        {
            "_band": matching.stage_band(F.col("stage"), F.size("q.tokens") > 1, policy.one_word_band),
            "_plain": F.when(F.col("q.fresh").isNotNull(), plain),
        }
    )
    rows = materialize(rows.withColumn("_profile", F.to_json(F.struct(*PROFILE))), "gates-candidates")
    profiles = rows.groupBy(per, "_profile", *PROFILE).agg(
        F.count("*").alias("n"),
        F.min("ord").alias("first"),
        *[F.max(f"q.{c}").alias(f"q_{c}") for c in ("family", "form", "fresh")],
    )
    verdicts = _verdicts(profiles, policy, per).select(per, "_profile", "target_family", "dropped_by")
    return spread_join(rows, verdicts, [per, "_profile"]).drop("_profile", "_band", "_plain")


def excluded_counts(gated: DataFrame, per: str = "query_id") -> DataFrame:
    """Per query: kept, and what each gate dropped."""
    dropped = lambda g: F.count_if(F.col("dropped_by") == g)
    return gated.groupBy(per).agg(
        F.count_if(F.col("dropped_by").isNull()).alias("kept"),
        dropped("stage").alias("stage_excluded"),
        dropped("family").alias("family_excluded"),
        dropped("form").alias("form_excluded"),
        dropped("fresh").alias("fresh_excluded"),
        F.max("target_family").alias("target_family"),
    )


def identity_lock(rows: DataFrame, per: str = "query_id") -> DataFrame:
    """+ dropped_by 'identity' for kept rows that cover fewer query words than the
    anchor: the most relevant row, online before others, then cheaper, then first.
    Needs q, it, rel, source, price, ord and product_id."""
    rows = rows.withColumn("_cover", matching.covered_tokens(F.col("q"), F.col("it")))
    order = F.struct(
        (-F.col("rel")).alias("rel"), (F.col("source") != "online").alias("aside"), "price", "ord", "_cover", F.col("product_id").alias("product")
    )
    anchor = rows.filter("dropped_by IS NULL").groupBy(per).agg(F.min(order).alias("_anchor"))
    rows = spread_join(rows, anchor, [per], "left")
    same = F.coalesce(F.col("product_id") == F.col("_anchor.product"), F.lit(False))
    covers = F.size(F.array_except("_anchor._cover", "_cover")) == 0
    locked = F.when(F.col("dropped_by").isNull() & (F.size("_anchor._cover") > 0) & ~same & ~covers, "identity")
    return rows.withColumn("dropped_by", F.coalesce("dropped_by", locked)).drop("_cover", "_anchor")
