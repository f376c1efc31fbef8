"""Joins with an order of preference, ranges and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize

#: Over how many parts the rows of one join key are spread: a share of the session's
#: shuffle partitions, within bounds, for each part has its own copy of the small side.
SALT_SHARE, LEAST_SALTS, MOST_SALTS = 8, 8, 64
#: Rows of a dictionary that a broadcast may have.
MOST_WORDS = 100_000


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``few``, which has a row or a fixed number of them for each key, to ``many``,
    of whose rows any share may have one key. Catalyst broadcasts a side where it is
    small. Where only ``few`` can be (joins that are not inner) its copies must be small:
    the salts are a table that multiplies its estimate, as a Parquet file's size says
    little of its rows in the driver's memory, and what was measured after the shuffle
    decides the rest. Otherwise a row's part comes from a hash of its values and of the
    part it lies in, so rows of one key are spread whether they differ or are repeated,
    and a task that runs again deals as before. What is still large in a part, Spark's
    skew join splits. Rows with a null key match nothing; where the join keeps them they
    are spread by the same hash."""
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = max(LEAST_SALTS, min(MOST_SALTS, parts // SALT_SHARE))
    if how == "inner":  # a larger estimate would only make Catalyst broadcast the other side
        copies = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_salt"))
    else:
        copies = few.crossJoin(F.broadcast(many.sparkSession.range(0, n, 1, 1).select(F.col("id").cast("int").alias("_salt"))))
    plain = [c for c, kind in many.dtypes if kind in ("string", "bigint", "int", "double", "boolean", "date", "timestamp")]
    dealt = F.xxhash64(F.spark_partition_id(), *plain)
    salt = F.pmod(dealt, F.lit(n)).cast("int")
    if how != "inner":
        some_null = F.lit(False)
        for k in keys:
            some_null = some_null | F.col(k).isNull()
        salt = F.when(some_null, (F.pmod(dealt, F.lit(1 << 16)) + n).cast("int")).otherwise(salt)
    return many.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def _deal(rows: DataFrame) -> Column:
    """A number from 1 to 65536 for each row, by a hash of its values and of the part it
    lies in: a task that runs again deals as before."""
    plain = [c for c, kind in rows.dtypes if kind in ("string", "bigint", "int", "double", "boolean", "date", "timestamp")]
    return (F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(1 << 16)) + 1).cast("int")


def large_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", deal: Column | None = None) -> DataFrame:
    """Join ``right``, which has at most a row for each key and grows with the input, to
    ``left``: sorted and merged, so never in the driver's memory, however little its files
    or columns take, and without copies. Rows with a null key match nothing; where the
    join keeps them they are spread, by ``deal`` if the rows were dealt before. A key with
    very many rows is split by Spark's skew join."""
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    left = left.withColumn("_salt", F.when(some_null, _deal(left) if deal is None else deal).otherwise(0))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")  # a literal would be folded into the condition and be no key
    return left.join(right.withColumn("_salt", zero).hint("merge"), [*keys, "_salt"], how).drop("_salt")


def dictionary_join(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a dictionary, which has at most a row for each key: counted, and
    broadcast whole up to ``MOST_WORDS`` rows; beyond that both sides are sorted and
    merged, so that neither is held, with ``few`` in copies for frequent words."""
    few = materialize(few, "dictionary")
    if few.count() <= MOST_WORDS:
        return many.join(F.broadcast(few), keys)
    return spread_join(many, few.hint("merge"), keys)


def first_match(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], result: str, order: str) -> DataFrame:
    """Left rows with ``result`` of the first of the key pairs that finds one; of
    equals the least by ``order``. Each step is an equi-join on distinct keys, in which
    rows with a null key, and those that have a result, are spread. Rows are dealt once,
    before the first step, and take a result and a step along, so what is not read
    afterwards is shuffled in no step."""
    columns = left.columns
    kind = right.schema[result].dataType
    tail = "_" * max((len(c) for c in columns), default=0)  # names that no column of the left has
    deal, found, step, k, r, s = (f"_{c}{tail}" for c in ("deal", "found", "step", "k", "r", "s"))
    rows = left.withColumns({deal: _deal(left), found: F.lit(None).cast(kind), step: F.lit(None).cast("int")})
    for i, (a, b) in enumerate(keys):
        least = right.filter(F.col(b).isNotNull()).groupBy(F.col(b).alias(k)).agg(F.min(F.struct(F.col(order).alias("_order"), F.col(result).alias("_result"))).alias("_m"))
        least = least.select(k, F.col("_m._result").alias(r), F.lit(i + 1).alias(s))
        asked = rows.withColumn(k, F.when(F.col(found).isNull(), F.col(a)))
        rows = large_join(asked, least, [k], "left", F.col(deal))
        rows = rows.withColumns({found: F.coalesce(found, r), step: F.coalesce(step, s)}).drop(k, r, s)
    return rows.select(*columns, F.col(found).alias(result), F.col(step).alias("matched_by"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, share: float) -> DataFrame:
    """Pairs with equal keys and positive amounts that differ by at most ``share`` of
    the larger. Amounts fall into logarithmic buckets one tolerance wide, so only
    neighbouring buckets meet."""
    width = F.lit(-1.000001 * math.log(1 - share))  # a little wide, so that rounding loses no pair
    bucket = lambda c: F.floor(F.log(F.col(c)) / width)
    near = left.filter(F.col(a) > 0).withColumn("_bucket", F.explode(F.array(*[bucket(a) + d for d in (-1, 0, 1)])))
    far = right.filter(F.col(b) > 0).withColumn("_bucket", bucket(b))
    high, low = F.greatest(a, b), F.least(a, b)
    return near.join(far, [*keys, "_bucket"]).filter(high - low <= share * high).drop("_bucket")


#: The finest grid has 2 ** FINEST cells a side.
FINEST = 12


def boxes_hit(points: DataFrame, boxes: DataFrame, page: str, least: float) -> DataFrame:
    """Per point (id, page, px, py) the box it hits: a direct hit before one in the
    box widened to ``least``, then the smaller box, then the first. Boxes (box_id, x,
    y, w, h; page fractions) are dealt to the cells of a grid as fine as the box is
    small, so each lies in four cells at most; a point asks its cell in every grid that
    its page has, and meets only boxes about as large as the cell. Of boxes alike in page
    and place only the first can be hit, so only it is dealt."""
    boxes = boxes.groupBy(page, "x", "y", "w", "h").agg(F.min("box_id").alias("box_id"))
    wide, tall = F.greatest("w", F.lit(least)), F.greatest("h", F.lit(least))
    boxes = boxes.withColumns(
        {"x0": F.col("x") + F.col("w") / 2 - wide / 2, "y0": F.col("y") + F.col("h") / 2 - tall / 2, "ww": wide, "hh": tall}
    )
    side = F.greatest("ww", "hh")
    grid = F.when(side > 0, F.greatest(F.least(F.floor(-F.log2(side)), F.lit(FINEST)), F.lit(0))).otherwise(FINEST).cast("int")
    boxes = boxes.withColumn("grid", grid)

    def cell(c: Column) -> Column:
        cells = F.expr("shiftleft(1, grid)")
        return F.least(F.greatest(F.floor(c * cells), F.lit(0)), cells - 1)

    over = lambda a, w: F.explode(F.sequence(cell(F.col(a)), cell(F.col(a) + F.col(w))))
    dealt = boxes.withColumn("cx", over("x0", "ww")).withColumn("cy", over("y0", "hh"))
    grids = boxes.groupBy(page).agg(F.collect_set("grid").alias("grids"))  # at most FINEST + 1 a page
    points = spread_join(points, grids, [page]).withColumn("grid", F.explode("grids")).drop("grids")
    points = points.withColumn("cx", cell(F.col("px"))).withColumn("cy", cell(F.col("py")))
    inside = lambda p, a, w: (F.col(p) >= F.col(a)) & (F.col(p) <= F.col(a) + F.col(w))
    pairs = points.join(dealt, [page, "grid", "cx", "cy"]).filter(inside("px", "x0", "ww") & inside("py", "y0", "hh"))
    pairs = pairs.withColumn("direct", inside("px", "x", "w") & inside("py", "y", "h"))
    order = F.struct((~F.col("direct")).alias("halo"), (F.col("w") * F.col("h")).alias("area"), "box_id")
    best = pairs.groupBy("id", page).agg(F.min(order).alias("best"))
    return best.select("id", page, "best.box_id", (~F.col("best.halo")).alias("direct"))
