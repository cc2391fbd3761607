"""The driver contract."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["month", "revenue", "orders", "avg_ticket", "mom_pct", "yoy_pct"]


def test_every_oracle_has_a_query():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    own = set(E.REGISTRY)  # the analytics operators; those of the optional subpackage have tests of their own
    assert len(set(sql) & own) >= len(own) - 5
    for body in sql.values():
        assert body.lstrip().upper().startswith("WITH")


def test_persisted_layout_follows_row_counts(spark):
    from mercato.context import spread

    df = spark.range(1000).withColumnRenamed("id", "order_id")
    dp = spark.sparkContext.defaultParallelism
    assert spread(df, "order_id").rdd.getNumPartitions() == dp
    spark.conf.set("mercato.rowsPerPartition", "10")
    try:
        n = max(dp, 100)
        assert spread(df, "order_id", rows=1000).rdd.getNumPartitions() == n
        assert spread(df, rows=995).rdd.getNumPartitions() == n  # ceil(995 / 10)
    finally:
        spark.conf.unset("mercato.rowsPerPartition")
