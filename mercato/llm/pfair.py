"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

A source's documents form blocks of ``block_rows``.  Weights are rounded to
parts of a period of ``period`` slots, p of P for a source.  Its i-th block
(from 0) is released at slot floor(i P / p) and due before slot
ceil((i + 1) P / p); in every slot the released block with the earliest
deadline goes (ties: the first source by name).  With weights that sum to 1 this keeps every
deadline, so up to any slot t a source has given out floor(t w) or ceil(t w)
blocks: it deviates by less than one block.  Because the pattern repeats after P
slots, one period is scheduled by a fold, and
block i of a source takes slot ``P * (i div p) + pattern(i mod p)``.  P is ``period``, or two slots a
source where there are more sources than that.  Sources of equal parts share their windows, so the fold
looks at one block per distinct part, of which there are at most about the square root of 2 P.  A source
that has run out leaves its slots empty; closing these gaps keeps the order and
the relative weights of the remaining sources, and no document is dropped or
repeated.

Documents are dealt to ``salt`` buckets inside their source before they are
numbered, as many as the square root of its rows, so a source with a third of
all rows is numbered in many tasks and its buckets' offsets stay few.

Defined results: a null source is a source of its own (sorts first); weights
default to the square root of each source's rows; sources with weight null or
not positive get the smallest part, 1.  Rows with equal ids are ordered
by text.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mercato.llm.common import discard, table, written

PERIOD = 1000
BLOCK_ROWS = 8


def period_parts(sizes: DataFrame, weights: DataFrame | None, period: int) -> DataFrame:
    """(source, rows, part): whole parts of the period, at least 1 each, by largest remainder; one row per source."""
    if weights is None:
        w = sizes.withColumn("weight", F.sqrt("rows"))
    else:
        w = sizes.join(weights.select(F.col("source").alias("s"), F.col("weight").cast("double")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    w = w.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0)))
    whole = Window.partitionBy()  # over one row per source
    spare = F.lit(period) - F.count("*").over(whole)
    w = w.withColumn("share", F.when(F.sum("weight").over(whole) > 0, F.col("weight") / F.sum("weight").over(whole))
                     .otherwise(1.0 / F.count("*").over(whole)) * spare)
    w = w.withColumn("low", F.floor("share")).withColumn("left", spare - F.sum(F.floor("share")).over(whole))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("share") - F.col("low")), "source"))
    return w.withColumn("part", (F.lit(1) + F.col("low") + (rank <= F.col("left")).cast("int")).cast("int")).select("source", "rows", "part")


def period_pattern(parts: DataFrame, period: int) -> DataFrame:
    """(source_no, i, offset): the slot of a source's i-th block in one period, by earliest deadline first.

    Sources of one part form a class: its j-th block is block ``j div m`` of its ``j mod m``-th source, m in number.
    The fold keeps, per class, the blocks given out; it runs over stretches of the period, whose plans are joined
    at the end, so that no growing list is copied slot by slot.
    """
    classes = (parts.groupBy("part").agg(F.sort_array(F.collect_list("source_no")).alias("who"))
               .agg(F.sort_array(F.collect_list(F.struct("part", "who"))).alias("cs")))
    stretch = max(1, int(period ** 0.5))
    # released: block * P / p <= t; deadline: ceil((block + 1) * P / p)
    pick = (f"array_min(filter(transform(cs, (c, k) -> named_struct('due', cast(ceil((acc.given[k] div size(c.who) + 1) * {period} / c.part) as int),"
            f" 'no', c.who[cast(acc.given[k] % size(c.who) as int)], 'k', k,"
            f" 'open', (acc.given[k] div size(c.who)) * {period} <= t * c.part)), x -> x.open))")
    step = (f"transform(array({pick}), b -> named_struct('given', transform(acc.given, (g, k) -> g + if(k = b.k, 1L, 0L)),"
            f" 'plan', array_append(acc.plan, b.no)))[0]")
    inner = (f"aggregate(sequence(s, least(s + {stretch}, {period}) - 1), named_struct('given', whole.given, 'plan', cast(array() as array<int>)),"
             f" (acc, t) -> {step})")
    outer = (f"transform(array({inner}), r -> named_struct('given', r.given, 'plans', array_append(whole.plans, r.plan)))[0]")
    state = "named_struct('given', transform(cs, c -> 0L), 'plans', cast(array() as array<array<int>>))"
    plan = classes.select(F.expr(f"flatten(aggregate(sequence(0, {period} - 1, {stretch}), {state}, (whole, s) -> {outer}).plans)").alias("plan"))
    slots = plan.select(F.posexplode("plan").alias("offset", "source_no")).where("source_no is not null")
    return slots.withColumn("i", F.row_number().over(Window.partitionBy("source_no").orderBy("offset")) - 1)


def mixed(docs: DataFrame, weights: DataFrame | None = None, period: int = PERIOD, block_rows: int = BLOCK_ROWS,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_row: bool = False) -> DataFrame:
    """One row per document: doc_id, source, source_no, part, rows, block, in_block, release, deadline, virtual_slot, period.

    The mix is the order of (virtual_slot, in_block).  ``keep_row`` adds the input row as struct ``row``.
    """
    keep = [F.struct(*docs.columns).alias("row")] if keep_row else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(text_col).alias("text_hash"), *keep)
    sizes = written(rows.groupBy("source").agg(F.count("*").alias("rows")), "mix-sizes")
    sources = sizes.count()
    period = period if sources <= period else 2 * sources
    parts = written(period_parts(sizes, weights, period)
                    .withColumn("source_no", F.row_number().over(Window.partitionBy().orderBy("source")) - 1), "mix-parts")
    discard(sizes)
    pattern = written(period_pattern(parts, period), "mix-pattern")

    # one row per source, and below one per slot of the period: Spark broadcasts them where they are small
    by_source = parts.withColumnRenamed("source", "s")
    dealt = (rows.join(by_source, rows["source"].eqNullSafe(F.col("s")), "inner").drop("s")
             .withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.ceil(F.sqrt("rows")))))
    held = dealt.groupBy("source_no", "salt").agg(F.count("*").alias("here"))
    ahead = Window.partitionBy("source_no").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(F.col("source_no").alias("sn"), F.col("salt").alias("sa"), F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("source_no", "salt").orderBy("doc_id", "text_hash")) - 1
    numbered = (dealt.withColumn("in_salt", place)
                .join(offsets, (F.col("source_no") == F.col("sn")) & (F.col("salt") == F.col("sa")))
                .withColumn("nth", F.col("before") + F.col("in_salt"))
                .withColumn("block", F.expr(f"nth div {block_rows}")).withColumn("in_block", F.expr(f"nth % {block_rows}")))
    turn = pattern.select(F.col("source_no").alias("sn2"), "i", "offset")
    return (numbered.join(turn, (F.col("source_no") == F.col("sn2")) & (F.expr("block % part") == F.col("i")))
            .withColumn("virtual_slot", F.expr(f"{period} * (block div part) + offset"))
            .withColumn("release", F.floor(F.col("block") * period / F.col("part")))
            .withColumn("deadline", F.ceil((F.col("block") + 1) * period / F.col("part")))
            .select("doc_id", "source", "source_no", "part", "rows", "block", "in_block", "release", "deadline", "virtual_slot",
                    F.lit(period).alias("period"), *(["row"] if keep_row else [])))


def with_slots(mix: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``slot``, the block's gapless place in the mix.

    Blocks are numbered within a period (at most as many as it has slots); the blocks before a period are a
    running sum over the periods, one row each.
    """
    blocks = mix.where("in_block = 0").select("source_no", "block", "virtual_slot", F.expr("virtual_slot div period").alias("q"))
    held = blocks.groupBy("q").agg(F.count("*").alias("here"))
    ahead = Window.partitionBy().orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    earlier = held.select("q", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("virtual_slot")) - 1
    numbered = (blocks.withColumn("rank", rank).join(earlier, "q")
                .select("source_no", "block", (F.col("earlier") + F.col("rank")).cast("long").alias("slot")))
    return mix.join(numbered, ["source_no", "block"])


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, in the order of the mix (range-partitioned and sorted, so files hold it)."""
    return (mixed(docs, keep_row=True, **options).repartitionByRange("virtual_slot", "in_block")
            .sortWithinPartitions("virtual_slot", "in_block").select("row.*"))


def with_mix_positions(mix: DataFrame) -> DataFrame:
    """Adds ``mix_position``, a row's place in the mix from 0, to rows read from files that ``in_mixed_order`` was written to.

    A scan deals files to tasks by size, so the place comes from the file (Spark numbers the part files in range
    order, and the further files of a part) and the row's index in it.
    """
    path = mix.metadataColumn("_metadata")["file_path"]
    files = [(r.file, r["count"]) for r in mix.groupBy(path.alias("file")).count().collect()]  # one row per file

    def place(file: str) -> tuple[int, int]:
        found = re.search(r"part-(\d+)-[^/]*?(?:[-.]c(\d+))?\.[^/]*$", file)
        if not found:
            raise ValueError(f"{file} is no part file of a mix")
        return int(found[1]), int(found[2] or 0)
    files.sort(key=lambda x: place(x[0]))
    starts = [0, *accumulate(n for _, n in files)]
    offsets = mix.sparkSession.createDataFrame([(f, at) for (f, _), at in zip(files, starts)], "mix_file string, mix_start long")
    rows = mix.select(F.struct(*mix.columns).alias("row"), path.alias("file"), mix.metadataColumn("_metadata")["row_index"].alias("at"))
    return (rows.join(F.broadcast(offsets), F.col("file") == F.col("mix_file"))  # one row per file
            .select(*[F.col("row")[c].alias(c) for c in mix.columns if c != "mix_position"], (F.col("mix_start") + F.col("at")).alias("mix_position")))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, release, deadline and slot in a mix of the sources by the square root of their sizes."""
    return with_slots(written(mixed(table(spark, sf_dir, "documents")), "mix")).drop("rows", "source_no", "period")
