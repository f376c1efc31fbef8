"""Live JSON sources as a Spark data source, with one retry, and what runs remember.

``spark.read.format("listings_json")`` reads one URL per store, each in a task of its own:
options ``urls`` (JSON object store -> URL), ``rows`` (name of the array in the answer),
``retry_ms`` and ``timeout_s``. A URL that fails is asked once more; then the task fails
with the store's name, unless ``best_effort`` is true, which gives no rows for it.
``listings_search`` asks for searches, a page a task, with what is wanted and how much in the request.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import StateTable

COLUMNS = "store string, id string, name string, image string, price double, oldPrice double, currency string, link string, size string, brand string, discountLabel string"
TEXTS = ("id", "name", "image", "currency", "link", "size", "brand", "discountLabel")


class StorePartition(InputPartition):
    def __init__(self, store: str, url: str):
        self.store, self.url = store, url


def _number(value):
    """A number, or a text that is one, as float; else None. Infinities are none."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return x if x - x == 0 and not isinstance(value, bool) else None


def fetch_rows(url: str, rows: str = "results", retry: float = 0.4, timeout: float = 20.0) -> list[dict]:
    """The objects in the array ``rows`` of a JSON answer, or in the answer itself. What
    fails is asked once more; the reason that the answer states is raised."""
    reason = None
    for attempt in range(2):
        if attempt:
            time.sleep(retry)
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                found = json.loads(answer.read())
            listed = found.get(rows) if isinstance(found, dict) else found
            if not isinstance(listed, list):
                raise ValueError(found.get("error") if isinstance(found, dict) and found.get("error") else "the answer has no rows")
            return [r for r in listed if isinstance(r, dict)]
        except urllib.error.HTTPError as e:
            try:
                reason = json.loads(e.read()).get("error") or e
            except Exception:
                reason = e
        except Exception as e:  # a source may fail in any way of its own
            reason = e
    raise RuntimeError(str(reason))


def listing_of(store: str, row: dict) -> tuple:
    texts = {c: None if row.get(c) is None else str(row[c]) for c in TEXTS}
    return (
        store, texts["id"], texts["name"], texts["image"], _number(row.get("price")), _number(row.get("oldPrice")),
        texts["currency"], texts["link"], texts["size"], texts["brand"], texts["discountLabel"],
    )


class ListingsReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options["urls"])
        self.rows = options.get("rows", "results")
        self.retry, self.timeout = int(options.get("retry_ms", "400")) / 1000, float(options.get("timeout_s", "20"))
        self.best_effort = options.get("best_effort", "false").lower() == "true"

    def partitions(self):
        return [StorePartition(s, u) for s, u in sorted(self.urls.items())]

    def read(self, partition):
        try:
            found = fetch_rows(partition.url, self.rows, self.retry, self.timeout)
        except RuntimeError as reason:
            if self.best_effort:
                return
            raise RuntimeError(f"{partition.store}: {reason}") from reason
        for row in found:
            yield listing_of(partition.store, row)


class ListingsSource(DataSource):
    @classmethod
    def name(cls):
        return "listings_json"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return ListingsReader(self.options)


def read_stores(spark: SparkSession, urls: dict[str, str], best_effort: bool = False, **options) -> DataFrame:
    """The listings of several stores, read side by side."""
    spark.dataSource.register(ListingsSource)
    reader = spark.read.format("listings_json").option("urls", json.dumps(urls)).option("best_effort", str(best_effort))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


class SearchPartition(InputPartition):
    def __init__(self, store: str, query: str, page: int):
        self.store, self.query, self.page = store, query, page


class SearchReader(ListingsReader):
    """Pages of searches, each a partition."""

    def __init__(self, options):
        super().__init__({**options, "urls": "{}"})
        self.template, self.stores, self.queries = options["template"], json.loads(options["stores"]), json.loads(options["queries"])
        self.pages, self.limit = int(options.get("pages", "1")), int(options.get("limit", "120"))

    def partitions(self):
        return [SearchPartition(s, q, p) for s in self.stores for q in dict.fromkeys(self.queries) for p in range(self.pages)]

    def read(self, partition):
        parts = {"store": partition.store, "query": urllib.parse.quote(partition.query), "page": partition.page, "limit": self.limit}
        try:
            found = fetch_rows(self.template.format(**parts), self.rows, self.retry, self.timeout)
        except RuntimeError as reason:
            if self.best_effort:
                return
            raise RuntimeError(f"{partition.store}: {reason}") from reason
        for row in found[: self.limit]:
            yield (*listing_of(partition.store, row), partition.query, partition.page)


class SearchSource(DataSource):
    @classmethod
    def name(cls):
        return "listings_search"

    def schema(self):
        return f"{COLUMNS}, query string, page int"

    def reader(self, schema):
        return SearchReader(self.options)


def search_stores(spark: SparkSession, template: str, stores: list[str], queries: list[str], pages: int = 1, limit: int = 120, best_effort: bool = False, **options) -> DataFrame:
    """Listings of searches at several stores that answer in one shape: a task for each
    store, query and page. ``template`` is a URL with {store}, {query}, {page}, {limit}:
    what is asked and how much goes into the request. Filters on the rows do not (Spark
    keeps a Python reader's pushed filters for every use of the same DataFrame)."""
    spark.dataSource.register(SearchSource)
    given = {"template": template, "stores": json.dumps(stores), "queries": json.dumps(queries), "pages": str(pages), "limit": str(limit), "best_effort": str(best_effort)}
    return spark.read.format("listings_search").options(**given, **{k: str(v) for k, v in options.items()}).load()


class StrategyMemory:
    """Which strategy gave rows last, by source. Where the table cannot be read or
    written nothing is remembered, and nothing fails."""

    SCHEMA = "source string, strategy string"

    def __init__(self, table: StateTable | None):
        self.table = table

    def winner(self, source: str) -> str | None:
        try:
            found = self.table.read().filter(F.col("source") == source).head(1)
            return found[0].strategy if found else None
        except Exception:
            return None

    def keep(self, source: str, strategy: str | None) -> None:
        """Remember a winner, or forget it (None)."""
        try:
            spark = self.table.spark
            rows = self.table.read().filter(F.col("source") != source)
            if strategy is not None:
                rows = rows.unionByName(spark.createDataFrame([(source, strategy)], self.SCHEMA))
            self.table.write(rows)
        except Exception:
            return


def scan_source(source: str, strategies, memory: StrategyMemory) -> tuple[str, DataFrame]:
    """The first strategy with rows, the remembered one tried first. The winner is
    remembered; if all fail it is forgotten and the reasons are raised."""
    from .listings import first_non_empty

    try:
        name, rows = first_non_empty(strategies, memory.winner(source))
    except LookupError:
        memory.keep(source, None)
        raise
    memory.keep(source, name)
    return name, rows


class SessionCache:
    """Results of a session by key, kept in Spark's cache. Past ``most`` entries all go
    at once; None is a result, too."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def get(self, key, make):
        if key not in self.held:
            if len(self.held) >= self.most:
                self.clear()
            rows = make()
            self.held[key] = rows.persist() if rows is not None else None
        return self.held[key]

    def clear(self) -> None:
        for rows in self.held.values():
            if rows is not None:
                rows.unpersist()
        self.held.clear()


def offers_for(query: str, search, cache: SessionCache, limit: int = 120) -> DataFrame | None:
    """The first ``limit`` offers of a query by ``search(query)``, which is ranked; None
    for an empty query or one without offers."""
    asked = (query or "").strip()
    if not asked:
        return None

    def make():
        rows = search(asked).limit(limit)
        return None if rows.isEmpty() else rows

    return cache.get((asked, limit), make)


def history_for(query: str, variants, cache: SessionCache) -> DataFrame | None:
    """The price history of a query by ``variants(query)``; None if nothing has been
    observed."""
    def make():
        rows = variants(query).filter("observations > 0")
        return None if rows.isEmpty() else rows

    return cache.get(query, make)
