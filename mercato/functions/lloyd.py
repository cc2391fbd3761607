"""Lloyd's rounds on integer features: repeatable to the last digit on any partitioning.

Features are whole numbers, so sums are exact; the starting centres are the rows whose ids hash lowest.
A round is one aggregate of counts and sums per centre (combined before the shuffle); one row per
centre reaches the driver.  Rounds end early when no centre moves, which gives what all rounds would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 12
GRID = 1 << 20  # min-max scaled features are rounded to this grid


def on_grid(value: Column, low: Column, high: Column) -> Column:
    """``value`` scaled to 0..GRID between low and high, rounded (the range counts as 1 where it is 0)."""
    width = F.when(high - low != 0, (high - low).cast("double")).otherwise(F.lit(1.0))
    return F.floor((value - low) / width * F.lit(float(GRID)) + 0.5).cast("long")


def distances(features: list[str], centres: list[list[float]]) -> list[Column]:
    out = []
    for c in centres:
        d = None
        for f, x in zip(features, c):
            term = (F.col(f) - F.lit(x)) * (F.col(f) - F.lit(x))
            d = term if d is None else d + term
        out.append(d)
    return out


def nearest(features: list[str], centres: list[list[float]]) -> Column:
    """Number of the nearest centre, the smaller one on ties."""
    d = distances(features, centres)
    chosen = F.lit(len(d) - 1)
    for i in range(len(d) - 2, -1, -1):
        first = F.lit(True)
        for other in d[i + 1:]:
            first = first & (d[i] <= other)
        chosen = F.when(first, i).otherwise(chosen)
    return chosen.cast("int")


def centres(rows: DataFrame, id_col: str, features: list[str], ks: list[int], rounds: int = ROUNDS) -> list[list[list[float]]]:
    """For every number in ``ks`` its centres after ``rounds`` rounds, fewer where there are fewer rows; the rounds of all run together."""
    first = rows.orderBy(F.sha2(F.col(id_col).cast("string"), 256), id_col).limit(max(ks)).select(*features).collect()
    now = [[[float(r[f]) for f in features] for r in first[:k]] for k in ks]
    for _ in range(rounds if first else 0):
        runs = [F.struct(F.lit(i).alias("run"), nearest(features, c).alias("c")) for i, c in enumerate(now)]
        chosen = runs[0] if len(runs) == 1 else F.explode(F.array(*runs))
        sums = rows.select(*features, chosen.alias("at")).groupBy("at.run", "at.c").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in features]).collect()  # on the grid sums of 2**43 rows fit a long
        moved = [list(c) for c in now]
        for r in sums:
            moved[r["run"]][r["c"]] = [float(r[f]) / float(r["n"]) for f in features]
        if moved == now:
            break
        now = moved
    return now
