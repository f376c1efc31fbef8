"""Streaming: stateful price crossings, windowed lows, standing watches, a change-only price
history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import matching
from ..functions.lexicon import Lexicon
from ..functions.size import parse_size
from ..operators import profiles, search
from ..operators.history import with_previous
from ..sources.store import StateTable, materialize, scratch_tables, sweep


def event_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files; ``ts`` becomes a timestamp that can be watermarked."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def crossing_alerts(events: DataFrame, target: float, lateness: str, key: str = "user_id") -> DataFrame:
    """A row whenever a watch's value falls to the target after one above it, or at
    its first value.

    Events wait in the watch's state until the watermark has passed them and are then
    judged in time order, so the order in which they arrive within ``lateness`` does
    not matter; later ones are dropped. The state is one boolean and the waiting events;
    a timeout at the earliest of them judges them when no new ones come. A null value
    neither fires nor arms."""
    schema = f"{key} bigint, event_id bigint, value double"
    state_schema = "below boolean, ts array<bigint>, ids array<bigint>, vals array<double>"

    def fire(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        below, ts, ids, vals = state.get if state.exists else (False, [], [], [])
        waiting = pd.DataFrame({"ts": list(ts), "event_id": list(ids), "value": list(vals)})
        for rows in batches if not state.hasTimedOut else ():
            rows = rows.dropna(subset=["value"])
            own = pd.DataFrame({"ts": rows["ts"].astype("datetime64[us]").astype("int64"), "event_id": rows["event_id"], "value": rows["value"]})
            waiting = pd.concat([waiting, own]) if len(waiting) else own
        waiting = waiting.sort_values(["ts", "event_id"])
        upto = state.getCurrentWatermarkMs() * 1000
        ready = waiting[waiting["ts"] <= upto] if len(waiting) else waiting
        left = waiting[waiting["ts"] > upto] if len(waiting) else waiting
        under = (ready["value"] <= target).astype(bool)
        was = under.shift(fill_value=bool(below)).astype(bool)
        if len(ready):
            below = bool(under.iloc[-1])
        state.update((bool(below), [int(v) for v in left["ts"]], [int(v) for v in left["event_id"]], [float(v) for v in left["value"]]))
        if len(left):
            state.setTimeoutTimestamp(max(int(left["ts"].iloc[0]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        fired = ready[under & ~was]
        yield pd.DataFrame({key: [int(k[0])] * len(fired), "event_id": fired["event_id"].astype("int64"), "value": fired["value"].astype("float64")})

    timely = events.withWatermark("ts", lateness).select(key, "event_id", "ts", "value")
    return timely.groupBy(key).applyInPandasWithState(fire, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_lows(events: DataFrame, length: str, lateness: str, key: str = "user_id") -> DataFrame:
    """Least value per key and tumbling window, final once the watermark has passed."""
    timely = events.withWatermark("ts", lateness)
    return timely.groupBy(F.window("ts", length), key).agg(F.min("value").alias("low"), F.count("*").alias("n")).select(
        F.col("window.start").alias("from"), key, "low", "n"
    )


#: A standing watch: what it looks for, its own size, its price, and the state of its last
#: check: whether the price was under the target, also before that, and its number.
WATCH = "watch_id bigint, query string, size string, target double, below boolean, was boolean, checked bigint"


def standing_watches(table: StateTable, alerts_path: str, lexicon: Lexicon):
    """A ``foreachBatch`` writer that checks watches against each batch of offers (ord,
    name, brand, price, source, size: as text).

    ``table`` holds the watches (``WATCH``, keyed by watch_id) and may change between
    batches; each batch meets them as they are then, by the keys of their words. A watch
    whose cheapest candidate falls to its target gets a row (watch_id, price, best) below
    ``alerts_path``, under the batch's number, and the state of the watches that had a
    candidate is committed. A batch that comes again finds the state from before it and
    writes the same rows. Changes that others commit meanwhile stay."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch_tables() as own:
            watches = table.read().withColumn("query_id", F.col("watch_id"))
            again = F.coalesce(F.col("checked") == batch_id, F.lit(False))
            watches = watches.withColumns({"below": F.when(again, F.col("was")).otherwise(F.col("below")), "own_size": parse_size(F.col("size"))})
            asked = matching.with_query(watches, lexicon).select("query_id", "q", "watch_id", "own_size")
            offers = matching.with_item(batch.withColumn("size", parse_size(F.col("size"))), lexicon)
            judged = profiles.watch_candidates(search.candidates(asked, offers), lexicon).select("watch_id", "ord", "price", "reason")
            done = profiles.evaluated_watches(judged, watches.select("watch_id", "target", "below")).filter("price IS NOT NULL")
            done = materialize(done.join(watches.select("watch_id", F.col("below").alias("was")), "watch_id"), "watch-check")
            done.filter("fires").select("watch_id", "price", "best").write.mode("overwrite").parquet(f"{alerts_path}/check={batch_id}")
            state = done.select("watch_id", F.col("below").alias("_below"), F.col("was").alias("_was"), F.lit(True).alias("_seen"))

            def step(rows: DataFrame) -> DataFrame:
                rows = rows.join(state, "watch_id", "left")
                new = {"below": F.col("_below"), "was": F.col("_was"), "checked": F.lit(batch_id).cast("bigint")}
                rows = rows.withColumns({c: F.when(F.col("_seen"), v).otherwise(F.col(c)) for c, v in new.items()})
                return rows.drop("_below", "_was", "_seen")

            table.change(step, state.select("watch_id"))
        sweep(own)

    return write


#: Parts in which a history lies, by a hash of the identity.
BUCKETS = 64


def merge_history(history_path: str, per: list[str], order: list[str], price: str, lateness: float | None = None):
    """A ``foreachBatch`` writer of a change-only history.

    A batch reads and writes only the buckets of its identities: their rows and its own
    are ordered together, and each is marked as a point or not, so late rows make the
    points that they should and a batch that comes again changes nothing. With
    ``lateness`` (in units of the first order column) observations older than that
    against the newest of their identity are closed: of these only points are held, and
    later arrivals among them are dropped. Without it all are held, for any order of
    arrival."""
    first, columns = order[0], list(dict.fromkeys([*per, *order, price]))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns).distinct()
        table = StateTable(batch.sparkSession, history_path, keys=tuple(per), buckets=BUCKETS)

        def step(held: DataFrame | None) -> DataFrame:
            new = rows
            if held is not None and lateness is not None:
                newest = held.groupBy(*per).agg(F.max(first).alias("_newest"))
                open_ = F.col("_newest").isNull() | (F.col(first) >= F.col("_newest") - lateness)
                new = rows.join(newest, per, "left").filter(open_).select(*columns)
            every = new if held is None else held.select(*columns).union(new).distinct()
            marked = with_previous(every, per, order, price, "point")
            if lateness is None:
                return marked
            newest = every.groupBy(*per).agg(F.max(first).alias("_newest"))
            return marked.join(newest, per).filter(F.col("point") | (F.col(first) >= F.col("_newest") - lateness)).drop("_newest")

        table.change(step, rows)

    return write


def current_history(spark, history_path: str, per: list[str], order: list[str], price: str) -> DataFrame:
    """The change-only points so far: those at which the price differs from the one
    before. A scan of the marked rows, however many batches have made them."""
    return StateTable(spark, history_path, keys=tuple(per), buckets=BUCKETS).read().filter("point").select(*dict.fromkeys([*per, *order, price]))
