"""Exports as groups of files with one header, shared by the three readers.

A folder may hold exports whose columns differ in order, number or name.  Each file's header line is found first;
files with the same header form a group, and a group's fields are placed by its own header.  The number of distinct
headers (not of files) reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.scratch import discard, written
from mercato.sources.headers import Names, fields, separator
from mercato.sources.ranges import csv_scan, cut, first_pieces, joined, line_no, pieces, range_starts, split, without_return


@dataclass
class Group:
    """Files that share a header: its column names, and the rows (line_no, c0..., surplus) below it."""

    headers: list[str]
    rows: DataFrame


def first_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(f, line): the first line of each file that is not blank."""
    lines = first_pieces(pieces(spark, path, "\n", encoding).where(F.trim("value") != ""))  # one a range
    return lines.groupBy("f").agg(F.min_by("value", "block").alias("line"))


def groups(spark: SparkSession, path: str | list[str], heads: DataFrame, names: Names, encoding: str = "UTF-8",
           sep: str | None = None) -> list[Group]:
    """The rows below each file's header line; ``heads`` holds (f, line)."""
    heads = written(heads.select("f", F.regexp_replace("line", "\r$", "").alias("line")), "export-heads")
    lines = sorted(r[0] for r in heads.select("line").distinct().collect())
    if not lines:
        return []
    seps = [sep or separator(line, names) for line in lines]
    headers = [fields(line.lstrip("﻿"), s) for line, s in zip(lines, seps)]
    known = spark.createDataFrame([(line, i) for i, line in enumerate(lines)], "line string, kind long")
    kinds = heads.join(F.broadcast(known), "line").select("f", "kind")  # one row per distinct header
    read, scans = pieces(spark, path, "\n", encoding), [csv_scan(s) for s in seps]
    starts = range_starts(read, kinds, scans, heads=lines)
    # one row per file; the header stands where the first record equals its line
    lost = F.raise_error(F.concat(F.lit("a header line stands inside a quoted field: "), F.substring("line", 1, 80))).cast("long")
    begins = written(starts.groupBy("f", "kind").agg(F.min("head").alias("head")).join(F.broadcast(known), "kind").select(
        "f", F.col("line").alias("header"), F.coalesce("head", lost).alias("head")), "export-begins")

    width = max(map(len, headers)) + 1  # the first field behind a file's own columns is its surplus
    columns = [f"c{j}" for j in range(width)]

    def below(rows: DataFrame) -> DataFrame:
        """``record`` without its return; null for what is not below its file's header."""
        record, part = without_return(F.col("record")), without_return(without_return(F.col("record")))
        wanted = (F.col("line_no") > F.col("head")) & (record != F.col("header")) & (F.length(part) > 0)
        return rows.join(F.broadcast(begins), "f").withColumn("below", F.when(wanted, part))

    def placed(rows: DataFrame) -> DataFrame:
        """The fields of ``below`` as columns; a record is split once, however many passes its readers take."""
        row = None
        for s in dict.fromkeys(seps):
            of = F.col("kind").isin([i for i, x in enumerate(seps) if x == s])
            row = F.when(of, split(F.col("below"), width, s)) if row is None else row.when(of, split(F.col("below"), width, s))
        return rows.withColumn("_c", row).select("*", *[F.col("_c")[c].alias(c) for c in columns])

    # whole records go from the text to their fields; only the fragments at the ends of ranges stay text
    parts = below(cut(read, starts, scans).withColumn("line_no", line_no()).withColumn("whole", F.col("part") == 0))
    parts = parts.withColumn("below", F.when(F.col("whole"), F.col("below"))).withColumn("record", F.when(~F.col("whole"), F.col("record")))
    cells = written(placed(parts.where("not whole or below is not null"))
                    .select("f", "block", "kind", "line", "part", "line_no", "record", *columns), "export-fields", "zstd")
    ends = joined(cells.where("part > 0").select("f", "block", "kind", "line", "part", "record"))
    mended = written(placed(below(ends).where("below is not null")).select("kind", "line_no", *columns), "export-fragments")
    discard(starts, begins)
    rows = cells.where("part = 0").select("kind", "line_no", *columns).unionByName(mended)
    return [Group(h, rows.where(F.col("kind") == i).select("line_no", *columns[:len(h)], F.col(columns[len(h)]).alias("surplus")))
            for i, h in enumerate(headers)]
