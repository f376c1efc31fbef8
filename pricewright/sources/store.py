"""Tables of a run's own in the folder that all executors share, and small state tables."""

from __future__ import annotations

import atexit
import json
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scratch paths that nothing has discarded: path -> session.
_LEFT: dict[str, SparkSession] = {}
#: The lists of ``scratch_tables`` blocks that are open in this thread.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the cluster
    names it, else the context's checkpoint folder. Where neither is set, a local
    session gets a folder of its own, and a cluster one in the warehouse, unless that
    lies on the machines' own disks: then it is refused."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.startswith("local["):
        context.setCheckpointDir("/tmp/checkpoints")
        named = context.getCheckpointDir()
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if urlsplit(warehouse).scheme in ("", "file"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{warehouse}/scratch"
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of a run's own; what lies there goes when the driver ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    for own in _OPEN.get():
        own.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it.

    It cuts the lineage durably: a lost executor costs a task, not the plan, and
    Catalyst sees the written size when it chooses between join strategies. What is
    not discarded before goes when the driver ends.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are worth a task of their own where each costs much.
ROWS_A_TASK = 2000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` of a table dealt by ``key`` to as many tasks as their number is worth, up
    to the session's shuffle partitions or thrice its cores. A scan makes its tasks by
    bytes, and a million thin rows lie in one file of a few megabytes: what costs
    milliseconds a row would then be one task's work. The count reads no column."""
    spark = rows.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(max(1, min(most, -(-rows.count() // ROWS_A_TASK))), key)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, path)
        for known in [k for k in _LEFT if k.rsplit("/", 1)[1] == path.rsplit("/", 1)[1]]:
            del _LEFT[known]


@contextmanager
def scratch_tables():
    """A list that, when the block ends, names the tables that this thread has written
    in it and left; those of other threads' runs are theirs."""
    found: list[str] = []
    token = _OPEN.set((*_OPEN.get(), found))
    try:
        yield found
    finally:
        _OPEN.reset(token)
        found[:] = [p for p in found if p in _LEFT]


def sweep(paths: list[str]) -> None:
    """Delete the tables at these paths, if they are still there."""
    for path in paths:
        if spark := _LEFT.pop(path, None):
            _delete(spark, path)
    paths.clear()


@atexit.register
def _sweep_all() -> None:
    try:
        sweep(list(_LEFT))
    except Exception:  # the session has ended before the driver
        _LEFT.clear()


class StateTable:
    """A keyed state (carts, profiles, positions, watches, histories) as Parquet below a
    path, with a log of commits.

    Rows lie in buckets by a hash of ``keys`` (one bucket without keys). A commit names
    the folder that holds each bucket now; its file is made whole and then put at the
    next number in one step that fails if another writer has taken it. So a reader sees
    the state before a commit or after it, and a change writes only the buckets it
    touches. A writer that comes second adds its buckets to the newer commit if that left
    them alone, and else makes its change again from the newer state: no change is lost.
    """

    def __init__(self, spark: SparkSession, path: str, schema=None, keys: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.buckets = tuple(keys), buckets if keys else 1

    def _at(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The commits that are kept, oldest first."""
        top, files = self._at("log")
        names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _commit_of(self, version: int) -> dict:
        where, files = self._at("log", f"{version:010d}")
        stream = files.open(where)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict]:
        known = self.versions()
        return (known[-1], self._commit_of(known[-1])) if known else (-1, {"buckets": {}})

    def _put(self, version: int, commit: dict) -> bool:
        """Put a commit at its number; false if there is one."""
        jvm = self.spark._jvm
        made, files = self._at("made", uuid.uuid4().hex)
        stream = files.create(made, False)
        stream.write(json.dumps(commit).encode())
        stream.close()
        target, _ = self._at("log", f"{version:010d}")
        files.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            context.rename(made, target, options)
            return True
        except Py4JJavaError as taken:
            if "FileAlreadyExists" not in str(taken.java_exception.getClass().getName()):
                raise
            files.delete(made, False)
            return False

    def _bucket(self, rows: DataFrame) -> DataFrame:
        number = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)
        return rows.withColumn("_bucket", number)

    def _read(self, commit: dict, only: set[str] | None = None) -> DataFrame:
        schema = self.schema or T.StructType.fromJson(commit["schema"])
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, folder in commit["buckets"].items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The current state, or that of a commit; no rows before the first."""
        number, commit = self._newest() if version is None else (version, self._commit_of(version))
        if number < 0 and self.schema is None:
            raise LookupError(f"no state at {self.path}")
        return self._read(commit)

    def write(self, rows: DataFrame, keep: int = 2) -> int:
        """Make ``rows`` the state and forget all but the newest commits."""
        return self.change(lambda _: rows, keep=keep)

    def change(self, step, touched: DataFrame | None = None, keep: int = 2) -> int:
        """Commit ``step(state)``: a function from the rows before to the rows after. With
        ``touched``, rows that have the keys of all that changes, the step gets the rows
        of their buckets only and returns what these hold then."""
        only = None
        if touched is not None:
            only = {str(r._bucket) for r in self._bucket(touched).select("_bucket").distinct().collect()}  # a number of buckets
            if not only:
                return self._newest()[0]
        while True:
            number, commit = self._newest()
            after = step(self._read(commit, only) if number >= 0 or self.schema else None)
            folder = uuid.uuid4().hex
            self._bucket(after).write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            where, files = self._at("data", folder)
            made = {s.getPath().getName().removeprefix("_bucket=") for s in files.listStatus(where) if s.isDirectory()}
            mine = made | (only if only is not None else set(commit["buckets"]))
            base = commit
            while True:
                held = {b: f for b, f in base["buckets"].items() if b not in mine} | dict.fromkeys(made, folder)
                if self._put(number + 1, {"buckets": held, "schema": json.loads(after.schema.json())}):
                    self._forget(number + 1, keep)
                    return number + 1
                number, base = self._newest()
                if only is None or any(base["buckets"].get(b) != commit["buckets"].get(b) for b in mine):
                    break
            _delete(self.spark, f"{self.path}/data/{folder}")

    def _forget(self, newest: int, keep: int) -> None:
        """Delete the commits before the newest ``keep``, and the folders that none of
        the others name."""
        old = [v for v in self.versions() if v <= newest - keep]
        kept = {f for v in self.versions() if v > newest - keep for f in self._commit_of(v)["buckets"].values()}
        for v in old:
            gone = set(self._commit_of(v)["buckets"].values()) - kept
            _delete(self.spark, f"{self.path}/log/{v:010d}")
            for folder in gone:
                _delete(self.spark, f"{self.path}/data/{folder}")
