"""Exact order statistics, at every size by the same plan.

Quantiles are selected by histogram refinement, without a global sort and without a task that holds
all values:

1. copies collapse into one weighted row per distinct value (counted before the shuffle);
2. the values fall into logarithmic bins, ``floor(sign(v) * ln(1 + |v|) * 2**13)``, which keep their
   order; a window over the bins (at most about 300,000 for values within six decades, whatever the
   number of rows) turns their counts into ranks and finds the bins that hold a wanted rank;
3. only the values of those bins are looked at again, in one window per bin.

Groups are part of every key, so grouped quantiles take the same three steps together.  Everything is
one lazy plan of aggregates, joins and windows; nothing is collected or checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 13  # bins per unit of the natural logarithm


def _bin(value: Column) -> Column:
    v = value.cast("double")
    return F.floor(F.signum(v) * F.least(F.log1p(F.abs(v)), F.lit(1000.0)) * F.lit(float(BINS))).cast("long")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def ranked_values(freq: DataFrame, value: str, count: str, by: list[str], wanted) -> DataFrame:
    """The values at wanted ranks: ``by``, ``_n``, ``_at`` (a wanted struct), ``_value`` and ``_before``, the rows below it.

    ``freq`` holds one row per group and distinct value.  ``wanted(n)`` is an array column of structs with a field ``rank``
    (0-based, null where nothing is wanted), given the group's number of rows.
    """
    binned = freq.withColumn("_bin", _bin(F.col(value)))
    bins = binned.groupBy(*by, "_bin").agg(F.sum(count).alias("_m"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = F.sum("_m").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    placed = bins.select("*", run.alias("_hi"), F.sum("_m").over(group).alias("_n"))
    low = F.col("_hi") - F.col("_m")
    hits = F.filter(wanted(F.col("_n")), lambda t: (t["rank"] >= low) & (t["rank"] < F.col("_hi")))
    found = placed.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bin").alias("_hit"), low.alias("_lo"), "_n",
                          hits.alias("_hits")).where(F.size("_hits") > 0)
    on = F.col("_bin") == F.col("_hit")
    for i, c in enumerate(by):
        on = on & _same(c, f"_by{i}")
    inside = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("_lo") + F.sum(count).over(inside)
    values = binned.join(found, on).select(*by, "_n", "_hits", F.col(value).alias("_value"), F.col(count).alias("_c"), through.alias("_through"))
    before = F.col("_through") - F.col("_c")
    mine = F.filter("_hits", lambda t: (t["rank"] >= before) & (t["rank"] < F.col("_through")))
    return values.select(*by, "_n", "_value", before.alias("_before"), F.explode(mine).alias("_at"))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None, prefix: str = "q",
                    weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles (pandas / numpy default).

    One row per group of ``by`` (one row without groups) with columns ``{prefix}{i}`` for each requested fraction, plus ``_n``
    (non-null count).  Null and NaN values are ignored; ``weight`` says how many rows a row stands for.
    """
    by = list(by or [])
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    freq = data.groupBy(*by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_c"))

    def wanted(n: Column) -> Column:
        out = []
        for i, q in enumerate(qs):
            h = (n - 1) * F.lit(float(q))
            low = F.floor(h).cast("long")
            for top, rank in ((False, low), (True, F.least(low + 1, n - 1))):
                out.append(F.struct(F.lit(i).alias("i"), F.lit(top).alias("top"), (h - low).alias("share"), rank.alias("rank")))
        return F.array(*out)
    picked = ranked_values(freq, value, "_c", by, wanted).select(*by, "_n", F.col("_value").cast("double").alias("_value"), "_at.*")
    aggs = [F.max("_n").alias("_n")]
    for i in range(len(qs)):
        low, high = (F.max(F.when((F.col("i") == i) & (F.col("top") == top), F.col("_value"))) for top in (False, True))
        aggs.append((low + F.max(F.when(F.col("i") == i, F.col("share"))) * (high - low)).alias(f"{prefix}{i}"))
    return picked.groupBy(*by).agg(*aggs)


def _tie_keys(df: DataFrame, value: str, key: str, cuts: DataFrame) -> DataFrame:
    """(cut, value, key): among the rows of each cut's value the key at 0-based place ``place``, in key order.

    The place is narrowed by the keys' first characters, so that no task sorts all rows of a common value.
    """
    rows = df.select(F.col(value).alias("_v"), F.col(key).alias("_k")).join(F.broadcast(cuts), F.col("_v") == F.col("_value"))
    rows = rows.select("cut", "_v", "_k", "place")
    for size in (3, 6):
        head = rows.groupBy("cut", "place", F.substring("_k", 1, size).alias("_h")).agg(F.count(F.lit(1)).alias("_m"))
        run = F.sum("_m").over(Window.partitionBy("cut").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))
        low = F.col("_run") - F.col("_m")
        chosen = head.withColumn("_run", run).where((F.col("place") >= low) & (F.col("place") < F.col("_run"))).select(
            F.col("cut").alias("_cut"), "_h", (F.col("place") - low).alias("_rest"))
        # one row per cut
        rows = rows.join(F.broadcast(chosen), (F.col("cut") == F.col("_cut")) & (F.substring("_k", 1, size) == F.col("_h"))).select(
            "cut", "_v", "_k", F.col("_rest").alias("place"))
    nth = F.row_number().over(Window.partitionBy("cut").orderBy("_k")) - 1
    return rows.withColumn("_nth", nth).where(F.col("_nth") == F.col("place")).select("cut", F.col("_v").alias("value"), F.col("_k").alias("key"))


def quantile_bin(df: DataFrame, value: str, q: int, key: str, out: str, reverse: bool = False) -> DataFrame:
    """Equal-frequency bin 1..q of ``value``; see ``quantile_bins``."""
    return quantile_bins(df, [(value, q, out, reverse)], key)


def quantile_bins(df: DataFrame, specs: list[tuple], key: str) -> DataFrame:
    """Equal-frequency bins 1..q (pandas ``qcut`` semantics) for several columns: specs are (value, q, out, reverse).

    Edges are the exact interpolated quantiles, intervals right-closed with the
    minimum in bin 1.  When edges repeat, ``qcut`` cannot label the bins; the
    fallback bins the 1-based rank instead (ties broken by the unique ``key``), i.e.
    ``greatest(1, ceil(q * (rank - 1) / (n - 1)))``: a row is above bin b when it
    comes after the row of rank ``1 + floor(b (n - 1) / q)``, and those q - 1 rows
    are selected like quantiles.  ``reverse`` maps bin b to q + 1 - b (recency scores).
    Edges of all columns come from one query; they are a few numbers a column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), F.col(v).cast("double").alias("_v"))
                                         for j, (v, *_) in enumerate(specs)])).alias("x")).select("x.*")
    sizes = sorted({q for _, q, *_ in specs})
    fracs = sorted({i / q for q in sizes for i in range(q + 1)})
    rows = {r["_j"]: r for r in exact_quantiles(long, "_v", fracs, by=["_j"], prefix="_e").collect()}  # one row a column
    res = df
    for j, (v, q, out, rev) in enumerate(specs):
        r = rows.get(j)
        edges = [r[f"_e{fracs.index(i / q)}"] for i in range(q + 1)] if r else None
        if edges is None:
            b = F.lit(None).cast("int")
        elif all(edges[i] < edges[i + 1] for i in range(q)):
            b = F.lit(1)
            for e in edges[1:q]:
                b = b + (F.col(v) > F.lit(e)).cast("int")
        else:
            n = r["_n"]
            freq = df.where(F.col(v).isNotNull()).groupBy(v).agg(F.count(F.lit(1)).alias("_c"))
            at = ranked_values(freq, v, "_c", [], lambda _, n=n, q=q: F.array(*[
                F.struct(F.lit(c).alias("cut"), F.lit(c * (n - 1) // q).cast("long").alias("rank")) for c in range(1, q)]))
            cuts = at.select("_value", F.col("_at.cut").alias("cut"), (F.col("_at.rank") - F.col("_before")).alias("place"))
            b = F.lit(1)
            for c in _tie_keys(df, v, key, cuts).collect():  # q - 1 rows
                x = F.lit(c["value"]).cast(df.schema[v].dataType)
                b = b + ((F.col(v) > x) | ((F.col(v) == x) & (F.col(key) > F.lit(c["key"])))).cast("int")
            b = F.when(F.col(v).isNotNull(), b)
        b = b.cast("int")
        res = res.withColumn(out, F.lit(q + 1) - b if rev else b)
    return res


def rows_within_share(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, rows): how many rows, largest ``value`` first, keep the running sum within ``share`` per cent of the total.

    The running sum is followed over the bins' sums, then over the distinct values of the bin in which a share is
    passed; among equal values the number of copies that still fit follows from the room that is left.
    Values are not negative but for the last of the order.
    """
    freq = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_bin", _bin(F.col(value)))
    bins = freq.groupBy("_bin").agg(F.sum("_c").alias("_rows"), F.sum(F.col(value) * F.col("_c")).alias("_sum"))
    # bins, not rows: see the module's note on their number
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.select("_bin", F.sum("_rows").over(down).alias("_rows_to"), F.sum("_sum").over(down).alias("_sum_to"), "_rows", "_sum",
                         F.sum("_sum").over(Window.partitionBy(F.lit(0))).alias("_total"))
    targets = F.explode(F.array(*[F.lit(s) for s in shares]))
    aimed = placed.select("*", targets.alias("share")).withColumn("_room", F.col("share") / 100 * F.col("_total"))
    passed = aimed.where(F.col("_sum_to") > F.col("_room")).groupBy("share").agg(F.max_by(F.struct(
        "_bin", (F.col("_rows_to") - F.col("_rows")).alias("rows"), (F.col("_sum_to") - F.col("_sum")).alias("sum"), "_total"), "_bin").alias("p"))
    # one row per share
    inside = freq.join(F.broadcast(passed.select("share", "p.*").withColumnRenamed("_bin", "_hit")), F.col("_bin") == F.col("_hit"))
    order = Window.partitionBy("share").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("sum") + F.coalesce(F.sum(F.col(value) * F.col("_c")).over(order), F.lit(0.0))
    v, total = F.col(value), F.col("_total")
    # copies k of v that fit: base + k v <= room
    left = F.col("share") / 100 * total - F.col("_base")
    fits = F.when(left < 0, 0).when(v <= 0, F.col("_c")).otherwise(F.least(F.col("_c"), F.floor(left / v)))
    counted = inside.select("share", "rows", "_total", v, "_c", base.alias("_base")).groupBy("share").agg(
        (F.max("rows") + F.sum(fits)).cast("long").alias("rows"))
    all_rows = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1))).scalar()
    wanted = df.sparkSession.createDataFrame([(s,) for s in shares], freq.sparkSession.range(0).select(F.lit(shares[0]).alias("share")).schema)
    return wanted.join(F.broadcast(counted), "share", "left").select("share", F.coalesce("rows", all_rows).alias("rows"))


def equal_width_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of pandas ``cut(x, bins)``: right-closed, first edge lowered by 0.1 %.

    Interior edges are ``lo + k * step`` computed like ``numpy.linspace``.
    """
    step = (hi - lo) / F.lit(float(bins))
    inner = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: k.cast("double") * step + lo)
    return F.size(F.filter(inner, lambda x: value > x))


def day_gaps(df: DataFrame, group: str, time: str, days) -> DataFrame:
    """(group, gap): whole days, one or more, between a group's consecutive times.

    Times of one calendar day are less than a whole day apart, so a day is one row with its first and last time
    (combined before the shuffle); the window over a group's days is bounded by the calendar.
    """
    per_day = df.where(F.col(time).isNotNull()).groupBy(group, F.to_date(time).alias("_day")).agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(group).orderBy("_day"))
    return (per_day.withColumn("_before", before).where(F.col("_before").isNotNull())
            .select(group, days("_first", "_before").alias("gap")).where("gap > 0"))
