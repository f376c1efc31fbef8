r"""Quality rules: base statistics and robust multivariate outliers.

Base statistics of a text come from array and regular expressions; a document whose
base rules fail is rejected. The others' statistics are transformed to a vector, and
per language and source its centre and covariance are estimated by the minimum
covariance determinant. Three deterministic starts (medians and quartile ranges; the
half of the rows nearest to those; all rows) each make two C-steps: keep the
``SUBSET`` share of rows that are nearest in Mahalanobis distance, take their mean and
covariance. Each group's start of least determinant goes on until its determinant
stands still. Rows within the 97.5 % quantile of that estimate give the reweighted one, and
rows beyond ``CUTOFF`` from it are rejected.

Quantiles come from histograms on a logarithmic scale (some thousand buckets at most
for any values), grouped before any shuffle by key, and rows meet their group's
estimate by a spread join, so a group with a third of all rows costs no more than
others; nothing is sorted or sampled. Only DataFrame expressions run; there is no
Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD_PATTERN, materialize, scratch_tables, spread_join, sweep, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: The vector: name, its SQL over the base statistics, and the standard deviation that
#: every estimate has at least (its square is added to the variance, so a determinant
#: is never 0). They are about a tenth of the range that ordinary prose covers, and
#: keep groups whose rows hardly differ (or not at all) from rejecting ordinary rows.
VECTOR = (
    ("x_length", "ln(1.0D + n_words)", 0.5),
    ("x_word", "word_chars / cast(n_words AS double)", 0.5),
    ("x_symbol", "ln(1.0D + 1000.0D * n_symbols / word_chars)", 0.5),
    ("x_lines", "n_dup_lines / cast(n_lines AS double)", 0.15),
    ("x_repeat", "n_repeat_words / cast(n_words AS double)", 0.15),
)
D = len(VECTOR)
NAMES = [n for n, _, _ in VECTOR]
#: The cells of a lower triangle, row by row, and the columns of an estimate.
CELLS = [(i, j) for i in range(D) for j in range(i + 1)]
ESTIMATE = [f"m{i}" for i in range(D)] + [f"k{i}_{j}" for i, j in CELLS]
#: Share of rows in the MCD subset, and that of the rows that one of the starts takes.
SUBSET, HALF = 0.75, 0.5
#: Squared distance within which rows count for the reweighted estimate: the 97.5 %
#: quantile of chi-square with five degrees of freedom.
INSIDE = 12.8325
#: Factors that make the covariance of the nearest share of a five-dimensional normal
#: sample consistent: share / P(chi-square with seven degrees <= the share's quantile
#: with five), for 75 %, 50 % and 97.5 %.
CONSISTENCY, HALF_CONSISTENCY, INSIDE_CONSISTENCY = 1.412, 1.912, 1.056
#: C-steps of every start, and of the best one at most; it ends before that when the
#: group's log determinant moves by no more than this.
FIRST_STEPS, MORE_STEPS, STILL = 2, 8, 1e-2
#: Squared Mahalanobis distance beyond which a row is an outlier: the quantile of
#: chi-square with five degrees of freedom that 1.5 of 10 million clean rows exceed.
CUTOFF = 40.0
#: Rows that a group needs for an estimate of its own.
MIN_GROUP = 100


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the array."""

    def windows(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def covered(starts):
        reach = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def repeated_starts(s):
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hits = F.filter(
            s, lambda x, k: ((k > 0) & same(x, F.get(s, F.greatest(k - 1, F.lit(0))))) | same(x, F.get(s, k + 1))
        )
        return F.array_sort(F.transform(hits, lambda x: x["p"]))

    def from_hashes(h):
        placed = F.array_sort(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
        some = let(let(placed, repeated_starts), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)

    return let(
        words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), from_hashes))
    ).cast("long")


def base_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, source, the columns of ``carry``, the base
    statistics (long) and base_failed. Null text counts as empty."""
    text = text_or_empty()
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD_PATTERN))
    kept = ["doc_id", "lang", "source", *carry]
    return (
        docs.select(*kept, text.alias("_text"))
        .select(
            *kept,
            let(words_of(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("_w"),
            F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), F.size(F.array_distinct(a)).cast("long").alias("d"))).alias("_l"),
        )
        .select(
            *kept,
            F.col("_w.n").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.col("_l.n") - F.col("_l.d")).alias("n_dup_lines"),
            F.col("_w.r").alias("n_repeat_words"),
            F.col("_l.n").alias("n_lines"),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
    )


def _quantile(rows: DataFrame, keys: list[str], bucket: str, shares: dict[str, float]) -> DataFrame:
    """Per key, the first bucket up to which ``share`` of the rows lie, by name."""
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(bucket))
    total = F.sum("_c").over(Window.partitionBy(*keys))
    return (
        counts.withColumn("_share", upto / total)
        .groupBy(*keys)
        .agg(*[F.min(F.when(F.col("_share") >= s, F.col(bucket))).alias(n) for n, s in shares.items()])
    )


def _groups(rows: DataFrame) -> DataFrame:
    """(lang_key, source_key) -> gid: the pair itself, or its language's sparse
    sources together, or all that is sparse."""
    pairs = rows.groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    sparse = pairs.filter(F.col("n") < MIN_GROUP).groupBy("lang_key").agg(F.sum("n").alias("n_lang"))
    return spread_join(pairs, sparse, ["lang_key"], "left").select(
        "lang_key",
        "source_key",
        F.when(F.col("n") >= MIN_GROUP, F.concat_ws("|", F.lit("s"), F.length("lang_key"), "lang_key", "source_key"))
        .when(F.col("n_lang") >= MIN_GROUP, F.concat_ws("|", F.lit("l"), "lang_key"))
        .otherwise("all")
        .alias("gid"),
    )


def _middle_start(rows: DataFrame) -> DataFrame:
    """Centre and whitening of the first start: medians and quartile ranges."""
    per_unit = 256.0
    long = rows.select(
        "gid",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.asinh(F.col(n)) * per_unit).alias("b")) for i, n in enumerate(NAMES)])).alias("v"),
    ).select("gid", "v.i", "v.b")
    q = _quantile(long, ["gid", "i"], "b", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    value = lambda c: F.sinh((F.col(c) + 0.5) / per_unit)
    aggs = []
    for i, (_, _, floor) in enumerate(VECTOR):
        here = F.col("i") == i
        spread = F.greatest((value("q3") - value("q1")) / 1.349, F.lit(floor))
        aggs.append(F.max(F.when(here, value("q2"))).alias(f"m{i}"))
        aggs += [
            (F.max(F.when(here, 1.0 / spread)) if i == j else F.max(F.lit(0.0))).alias(f"k{i}_{j}")
            for j in range(i + 1)
        ]
    return q.groupBy("gid").agg(*aggs)


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """The estimate of each key's rows: their mean and covariance, whitened."""
    out = rows.groupBy(*keys).agg(
        *[F.expr(f"avg({n})").alias(f"m{i}") for i, n in enumerate(NAMES)],
        *[F.expr(f"covar_pop({NAMES[i]}, {NAMES[j]})").alias(f"c{i}_{j}") for i, j in CELLS],
    )
    return _whitened(out, keys, factor)


def _whitened(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means and covariances -> the mean, the whitening (inverse Cholesky factor) of the
    covariance times ``factor`` and with the least variances, and its log determinant:
    column by column of the factor, then diagonal by diagonal of its inverse. One SQL
    text with a subquery for each level, so that Catalyst analyses it once."""
    added = lambda terms: " + ".join(terms) or "0D"
    levels = []
    for j in range(D):
        levels.append([f"sqrt(c{j}_{j} * {factor}D + {VECTOR[j][2] ** 2}D - ({added([f'l{j}_{k} * l{j}_{k}' for k in range(j)])})) AS l{j}_{j}"])
        levels.append([f"(c{i}_{j} * {factor}D - ({added([f'l{i}_{k} * l{j}_{k}' for k in range(j)])})) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, D)])
    levels.append([f"1D / l{i}_{i} AS k{i}_{i}" for i in range(D)])
    for d in range(1, D):
        levels.append([f"-({added([f'l{i}_{k} * k{k}_{i - d}' for k in range(i - d, i)])}) / l{i}_{i} AS k{i}_{i - d}" for i in range(d, D)])
    levels.append([f"2D * ({added([f'ln(l{i}_{i})' for i in range(D)])}) AS log_det"])
    query = "{moments}"
    for cells in filter(None, levels):
        query = f"(SELECT *, {', '.join(cells)} FROM {query})"
    return moments.sparkSession.sql(f"SELECT {', '.join([*keys, *ESTIMATE, 'log_det'])} FROM {query}", moments=moments)


#: The squared Mahalanobis distance of a row's vector under its row's estimate, and its
#: bucket, as SQL.
_TERMS = ["(" + " + ".join(f"k{i}_{j} * ({NAMES[j]} - m{j})" for j in range(i + 1)) + ")" for i in range(D)]
DISTANCE = " + ".join(f"{t} * {t}" for t in _TERMS)
BUCKET = f"cast(floor(ln({DISTANCE} + 1e-6D) * 32) AS bigint)"


def _c_step(rows: DataFrame, estimate: DataFrame, share: float = SUBSET, factor: float = CONSISTENCY) -> DataFrame:
    """The estimate of the ``share`` of each group's rows nearest to its estimate; one
    for each start ``s`` of a group, with the log determinant of the one ``before``. One
    pass over the rows sums their deviations by bucket of distance, and the buckets up to
    the share are added up."""
    deviation = [f"({n} - m{i})" for i, n in enumerate(NAMES)]
    sums = {"n": "count(*)"} | {f"a{i}": f"sum({d})" for i, d in enumerate(deviation)}
    sums |= {f"b{i}_{j}": f"sum({deviation[i]} * {deviation[j]})" for i, j in CELLS}
    found = ", ".join(f"{v} AS {c}" for c, v in sums.items())
    near = spread_join(rows, estimate, ["gid"])
    parts = rows.sparkSession.sql(f"SELECT gid, s, {BUCKET} AS bucket, {found} FROM {{near}} GROUP BY ALL", near=near)
    start = Window.partitionBy("gid", "s")
    upto = F.sum("n").over(start.orderBy("bucket")) - F.col("n")
    parts = parts.withColumns({"_before": upto, "_all": F.sum("n").over(start)}).filter(F.col("_before") < share * F.col("_all"))
    near = parts.groupBy("gid", "s").agg(*[F.sum(c).alias(c) for c in sums])
    before = F.col("log_det") if "log_det" in estimate.columns else F.lit(None).cast("double")
    near = near.join(estimate.select("gid", "s", before.alias("before"), *[F.col(f"m{i}").alias(f"o{i}") for i in range(D)]), ["gid", "s"])
    mean = [f"o{i} + a{i} / n AS m{i}" for i in range(D)]
    moments = near.selectExpr("gid", "s", "before", *mean, *[f"b{i}_{j} / n - (a{i} / n) * (a{j} / n) AS c{i}_{j}" for i, j in CELLS])
    return materialize(_whitened(moments, ["gid", "s", "before"], factor), "mcd-estimate")


def mcd_estimates(rows: DataFrame) -> DataFrame:
    """Rows with the vector and gid -> gid, the reweighted minimum covariance
    determinant estimate."""
    start = lambda df, s: df.withColumn("s", F.lit(s)).select("gid", "s", *ESTIMATE)
    middle = materialize(start(_middle_start(rows), 0), "mcd-middle")
    nearest = start(_c_step(rows, middle, HALF, HALF_CONSISTENCY), 1)
    everything = start(_moments(rows, ["gid"], 1.0), 2)
    estimate = materialize(middle.unionByName(nearest).unionByName(everything), "mcd-starts")
    for _ in range(FIRST_STEPS):
        estimate = _c_step(rows, estimate)
    columns = ["s", *ESTIMATE, "log_det"]
    least = F.min(F.struct(F.col("log_det").alias("_least"), *columns)).alias("_best")
    best = materialize(estimate.groupBy("gid").agg(least).select("gid", *[f"_best.{c}" for c in columns]), "mcd-best")
    ended = []
    for _ in range(MORE_STEPS):
        after = _c_step(rows, best)
        moves = F.abs(F.col("log_det") - F.col("before")) > STILL
        ended.append(after.filter(~moves).drop("before"))
        best = after.filter(moves).drop("before")
        if best.isEmpty():
            break
    for part in ended:
        best = best.unionByName(part)
    best = materialize(best, "mcd-ended")
    inside = spread_join(rows, best, ["gid"]).filter(f"{DISTANCE} <= {INSIDE}D")
    return materialize(_moments(inside, ["gid"], INSIDE_CONSISTENCY), "mcd-final")


def judge(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, text -> doc_id, the base statistics, base_failed, d2
    (null if base_failed) and kept, one row per input row.

    Null or empty text: no words, base_failed. Null lang or source: a group of its
    own. Null doc_id, repeated rows: judged alike. Very long texts: judged whole. Groups
    under ``MIN_GROUP`` rows pool with the sparse groups of their language, else with
    all sparse groups. Empty table: no rows. Further columns are ignored, but those of
    ``carry``, whatever their names, are returned as one struct ``carried``.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    carried = ("carried",) if carry else ()
    if carry:
        docs = docs.select("doc_id", "lang", "source", "text", F.struct(*[docs[c] for c in carry]).alias("carried"))
    stats = materialize(
        base_statistics(docs, carried).withColumns({"lang_key": key("lang"), "source_key": key("source")}), "rules-stats"
    )
    judged = stats.withColumns({n: F.when(~F.col("base_failed"), F.expr(e)) for n, e, _ in VECTOR})
    passed = judged.filter(~F.col("base_failed")).select("lang_key", "source_key", *NAMES)
    groups = materialize(_groups(passed), "rules-groups")
    vectors = spread_join(passed, groups, ["lang_key", "source_key"]).select("gid", *NAMES)
    with scratch_tables() as inner:
        estimates = mcd_estimates(materialize(vectors, "rules-vectors"))
        sites = materialize(groups.join(estimates, "gid").select("lang_key", "source_key", *ESTIMATE), "rules-sites")
    sweep([p for p in inner if "/rules-sites-" not in p])
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return (
        spread_join(judged, sites, ["lang_key", "source_key"], "left")
        .select(*base, F.when(~F.col("base_failed"), F.expr(DISTANCE)).alias("d2"), *carried)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF))
    )


def op8(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("d2")
