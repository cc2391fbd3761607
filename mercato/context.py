"""Context: the canonical input tables an operator may read.

Operators take a ``Context`` and parameters and return a DataFrame.  A context's
tables are lazy views: a single query reads only the columns and rows it needs.
With ``persist`` each table is built once and kept (memory, spilling to disk), for
runs of many operators over the same line and order
tables.  Persisted blocks that are lost with an executor are recomputed from
lineage, so a lost executor costs time, not correctness.
"""

from __future__ import annotations

from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_TABLES = ("lines", "orders", "campaign", "keyword", "search_term", "ad", "auction", "social", "events")


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Fix the partitioning of a table that is about to be persisted.

    A persisted table keeps the layout it was built with (a cached plan is
    not re-coalesced by AQE), and every operator reading it runs on that many
    tasks: a single-file input would leave one task, a fixed large count
    leaves thousands of near-empty tasks on small data.  The count follows
    the data: ``rows`` (a cheap upper bound, e.g. a parquet footer count of
    the base table) over ``mercato.rowsPerPartition``, and at least the
    cluster's default parallelism.  Hash-partitioning on the natural key (the
    order for lines and orders) keeps an order's lines together.
    """
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    if rows is not None:
        per = int(spark.conf.get("mercato.rowsPerPartition", "2000000"))
        n = max(n, -(-int(rows) // per))
    return df.repartition(n, *keys) if keys else df.repartition(n)


class MissingTable(LookupError):
    """A context has no such input table."""


class Context:
    def __init__(self, spark: SparkSession, persist: bool = False, **builders: Callable[[], DataFrame] | DataFrame):
        unknown = set(builders) - set(_TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self.spark = spark
        self._persist = persist
        self._builders = builders
        self._cache: dict[str, DataFrame] = {}

    def has(self, name: str) -> bool:
        return name in self._builders

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name not in self._builders:
                if name == "orders" and "lines" in self._builders:
                    from mercato.operators.store.orders import orders_from_lines
                    self._builders["orders"] = lambda: orders_from_lines(self.lines)
                else:
                    raise MissingTable(name)
            b = self._builders[name]
            df = b() if callable(b) else b
            if self._persist:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._cache[name] = df
        return self._cache[name]

    def derived(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from the inputs and shared by several operators, built once (and kept with ``persist``)."""
        name = "derived:" + key
        if name not in self._cache:
            df = build()
            if self._persist:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._cache[name] = df
        return self._cache[name]

    def unpersist(self) -> None:
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()

    lines = property(lambda self: self.table("lines"))
    orders = property(lambda self: self.table("orders"))
    campaign = property(lambda self: self.table("campaign"))
    keyword = property(lambda self: self.table("keyword"))
    search_term = property(lambda self: self.table("search_term"))
    ad = property(lambda self: self.table("ad"))
    auction = property(lambda self: self.table("auction"))
    social = property(lambda self: self.table("social"))
    events = property(lambda self: self.table("events"))

    # ------------------------------------------------------------ fixtures
    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str, persist: bool = False) -> "Context":
        """Canonical views derived from the benchmark parquet tables; with ``persist`` laid out by their keys and kept."""
        from mercato.sources import fixtures as fx

        def rows(table: str) -> int:
            # parquet row counts come from the file footers: no column data is read
            return fx.read(spark, sf_dir, table).count()

        def laid_out(view: DataFrame, *keys: str, of: str | None = None) -> DataFrame:
            return spread(view, *keys, rows=rows(of) if of else None) if persist else view

        return cls(
            spark, persist=persist,
            lines=lambda: laid_out(fx.lines_view(spark, sf_dir), "order_id", of="lineitem"),
            orders=lambda: laid_out(fx.orders_view(spark, sf_dir), "order_id", of="orders"),
            # campaign / social rows are aggregates on a bounded grain (day x hour x segment x device)
            campaign=lambda: laid_out(fx.campaign_view(spark, sf_dir)),
            keyword=lambda: laid_out(fx.keyword_view(spark, sf_dir), of="part"),
            search_term=lambda: laid_out(fx.search_term_view(spark, sf_dir), of="part"),
            ad=lambda: laid_out(fx.ad_view(spark, sf_dir), of="part"),
            auction=lambda: fx.auction_view(spark, sf_dir),
            social=lambda: laid_out(fx.social_view(spark, sf_dir)),
            events=lambda: laid_out(fx.events_view(spark, sf_dir), of="events"),
        )
