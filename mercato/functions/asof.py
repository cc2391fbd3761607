"""As-of lookups by one sorted sweep: for each wanted row the last marked row before it in its group.

A join on "the latest earlier row" would pair every row with its group's history, and a window would
put a whole group into one task.  Here all rows are range-partitioned by (group, order), so that even
a group holding most of the rows is spread over many tasks, and each task sweeps its sorted rows once,
carrying the last row of every mark.  A sweep ends with one edge row: its last group and what it
carries.  Edge rows (one per partition) are folded in order and handed to the next partitions, whose
first group may have found nothing of its own.  Only wanted rows and edge rows leave the sweep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.scratch import written


def last_seen(rows: DataFrame, group: str, order: list[str], marks: dict[str, Column], wanted: Column, carry: list[str],
              label: str = "as-of") -> DataFrame:
    """The ``wanted`` rows with ``{mark}_{column}`` of the last row of each mark, itself included, in its group.

    ``order`` sorts a group's rows and should leave no ties.  Rows without a group are left out.
    """
    names = rows.columns
    flags = {m: f"_is_{m}" for m in marks}
    kept = rows.select("*", *[F.coalesce(c, F.lit(False)).alias(flags[m]) for m, c in marks.items()],
                       F.coalesce(wanted, F.lit(False)).alias("_wanted"))
    some = F.col("_wanted")
    for f in flags.values():
        some = some | F.col(f)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (kept.where(F.col(group).isNotNull() & some).repartitionByRange(tasks, group, *order)
              .sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()))
    found = [T.StructField(f"{m}_{c}", rows.schema[c].dataType) for m in marks for c in carry]
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.BooleanType()), T.StructField("_whole", T.BooleanType())]
    extra += [T.StructField(f"_{kind}_{m}", T.BooleanType()) for m in marks for kind in ("has", "open")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + found + extra)

    def sweep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        state: dict = {m: None for m in flags}  # mark -> one-row arrays of the carried columns
        now, first, part, types = None, True, None, None  # first: still in the partition's first group
        out_names = [*names, *[f"{m}_{c}" for m in flags for c in carry], "_part", "_edge", "_whole",
                     *[f"_{kind}_{m}" for m in flags for kind in ("has", "open")]]
        for b in it:
            n = b.num_rows
            if n == 0:
                continue
            at = {name: b.column(b.schema.get_field_index(name)) for name in b.schema.names}
            g = at[group].to_numpy(zero_copy_only=False)
            if types is None:
                types, part, now = {name: at[name].type for name in names}, at["_part"][0].as_py(), (g[0],)
            change = np.ones(n, dtype=bool)
            change[1:] = g[1:] != g[:-1]
            change[0] = g[0] != now[0]
            start = np.maximum.accumulate(np.where(change, np.arange(n), -1))  # -1: the group began in an earlier batch
            in_first = (start == -1) if first else np.zeros(n, dtype=bool)
            take = np.flatnonzero(at["_wanted"].to_numpy(zero_copy_only=False))
            cols = [at[name].take(pa.array(take)) for name in names]
            seen, tails = {}, []
            for m, flag in flags.items():
                last = np.maximum.accumulate(np.where(at[flag].to_numpy(zero_copy_only=False), np.arange(n), -1))
                here = last >= np.maximum(start, 0)
                carried = ~here & (start == -1) & (state[m] is not None)
                index = np.where(here, last + 1, 0)[take]
                none = ~(here | carried)[take]
                for i, c in enumerate(carry):
                    before = state[m][i] if state[m] is not None else pa.nulls(1, types[c])
                    cols.append(pa.concat_arrays([before, at[c]]).take(pa.array(index, mask=none)))
                tails += [pa.array(~none), pa.array((none & in_first[take]))]
                if here[-1]:
                    seen[m] = [at[c].slice(int(last[-1]), 1) for c in carry]
                else:
                    seen[m] = state[m] if start[-1] == -1 else None
            k = len(take)
            if k:
                yield pa.record_batch([*cols, pa.array([part] * k, pa.int32()), pa.array([False] * k), pa.array([False] * k), *tails], names=out_names)
            state, now, first = seen, (g[-1],), first and not change.any()
        if now is not None:
            edge = [pa.array([now[0]], types[name]) if name == group else pa.nulls(1, types[name]) for name in names]
            for m in flags:
                edge += state[m] if state[m] is not None else [pa.nulls(1, types[c]) for c in carry]
            tails = [pa.array([x]) for m in flags for x in (state[m] is not None, False)]
            yield pa.record_batch([*edge, pa.array([part], pa.int32()), pa.array([True]), pa.array([first]), *tails], names=out_names)

    swept = written(placed.mapInArrow(sweep, schema), label)
    mark_columns = {m: [f"{m}_{c}" for c in carry] for m in marks}
    incoming, handed = None, []
    for e in sorted(swept.where("_edge").collect(), key=lambda r: r["_part"]):  # one row per partition
        if incoming is not None:
            handed.append((e["_part"], incoming[0], *[x for m in marks for x in (incoming[1][m] is not None, *(incoming[1][m] or [None] * len(carry)))]))
        passes = incoming if e["_whole"] and incoming is not None and incoming[0] == e[group] else None
        incoming = (e[group], {m: [e[c] for c in mark_columns[m]] if e[f"_has_{m}"] else passes and passes[1][m] for m in marks})
    hand_schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_group", rows.schema[group].dataType)] + [
        f for m in marks for f in [T.StructField(f"_in_{m}", T.BooleanType())] + [
            T.StructField(f"_in_{m}_{c}", rows.schema[c].dataType) for c in carry]])
    handed_on = rows.sparkSession.createDataFrame(handed, hand_schema)
    joined = swept.where("not _edge").join(F.broadcast(handed_on), "_part", "left")
    cols = [F.col(name) for name in names]
    for m in marks:
        late = F.col(f"_open_{m}") & F.coalesce(F.col(group) == F.col("_group"), F.lit(False)) & F.coalesce(f"_in_{m}", F.lit(False))
        cols += [F.when(late, F.col(f"_in_{m}_{c}")).otherwise(F.col(f"{m}_{c}")).alias(f"{m}_{c}") for c in carry]
    return joined.select(*cols)
