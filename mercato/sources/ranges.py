"""Records of large text files, read by many tasks.

A record of a CSV file may hold line breaks inside quotes, and the elements of a JSON array may stand on one
line, so a byte range of a file does not tell by itself where its first record starts.  Files are therefore
read as plain pieces (lines, or the stretches between closing braces), which Spark splits by bytes:

1.  Every range is scanned once from both states it may start in, outside and inside quotes; what leaves the task
    is one row per range: the state it ends in from either.
2.  These maps of two states are composed along each file by windows over its ranges: a range's start is the
    result of the last range that ends alike from both, turned by the number of ranges since that swap the states.
3.  With its true start a range is cut into records.  Records that stand whole in a range leave it as they are; the
    fragments at its ends (at most two a range) are joined along the file.

Quotes open only at the beginning of a field and are doubled inside; a quote within an unquoted field is text.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.scratch import discard, written
from mercato.session import ensure_checkpoint_dir

# the scanners travel to executors by value: they need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICED = 64  # lines without marks in a row that are passed on as one slice

_STRUCTURE = re.compile(r'["\\{}\[\]]')
_ARRAY_HEAD = re.compile(r'\s*(?:\{\s*"(?:data|results)"\s*:\s*)?\[')

#: A scanner: state inside quotes (0 or 1) and a piece -> state, change of depth, least depth on the way.
Scan = Callable[[int, str], tuple[int, int, int]]


def csv_scan(sep: str) -> Scan:
    def scan(inside: int, line: str) -> tuple[int, int, int]:
        at = 0
        while True:
            if not inside:
                if line[at:at + 1] != '"':
                    at = line.find(sep, at) + 1
                    if at == 0:
                        return 0, 0, 0
                    continue
                inside, at = 1, at + 1
            end = line.find('"', at)
            if end < 0:
                return 1, 0, 0
            if line[end + 1:end + 2] == '"':
                at = end + 2
                continue
            inside = 0
            at = line.find(sep, end + 1) + 1
            if at == 0:
                return 0, 0, 0
    return scan


def json_scan(inside: int, piece: str) -> tuple[int, int, int]:
    depth = low = skip = 0
    for m in _STRUCTURE.finditer(piece):
        c = m.group()
        if m.start() < skip:
            continue
        if inside:
            if c == "\\":
                skip = m.end() + 1
            elif c == '"':
                inside = 0
        elif c == '"':
            inside = 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            low = min(low, depth)
    return inside, depth, low


def pieces(spark: SparkSession, paths: str | list[str], line_sep: str, encoding: str = "UTF-8") -> DataFrame:
    """(f, block, n, value): hash of the file's path, first byte of the range, place in order, text.

    A task reads its ranges one after the other, each in order.
    """
    text = spark.read.option("encoding", encoding).option("lineSep", line_sep).text(paths)
    meta = text.metadataColumn("_metadata")
    value = F.coalesce("value", F.lit(""))
    if encoding.upper() not in ("UTF-8", "UTF8"):  # the source splits by this encoding but leaves the bytes as they are
        value = F.decode(value.cast("binary"), encoding)
    return text.select(F.xxhash64(meta["file_path"]).alias("f"), meta["file_block_start"].alias("block"),
                       F.monotonically_increasing_id().alias("n"), value.alias("value"))


def _by_range(it: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """Stretches of rows of one range, in order, with the range's own columns."""
    for b in it:
        if not b.num_rows:
            continue
        at = [b.column(b.schema.get_field_index(k)) for k in key]
        new = None
        for c in at[:2]:
            change = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
            new = change if new is None else pc.or_(new, change)
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield {k: c[i].as_py() for k, c in zip(key, at)}, b.slice(i, j - i)


_SUMMARY = ("f", "block", "kind", "m0", "d0", "l0", "m1", "d1", "l1", "h0", "h1")


def _summary(scans: list[Scan], end: str, marks: str, heads: list[str]):
    """One row per range: the states it ends in from outside and from inside quotes, with depths for JSON.

    With ``heads``, the header line of each kind, also the first line that is a whole record and equals it, from either state.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []
        at, seen = [None, None], 0
        for key, b in _by_range(it, ["f", "block", "kind"]):
            where = (key["f"], key["block"], key["kind"])
            first = where != now
            if first:
                if now:
                    rows.append((*now, *state[0], *state[1], *at))
                now, state = where, [(0, 0, 0), (1, 0, 0)]
                at, seen = [None, None], 0
            scan, values = scans[key["kind"]], b.column(b.schema.get_field_index("value"))
            head, lines = (), range(seen, seen + len(values))
            if end and first and key["block"] == 0:  # a document's head is no part of its elements
                texts = [_ARRAY_HEAD.sub("", values[0].as_py(), count=1), *values.slice(1).to_pylist()]
            elif end:
                texts = values.to_pylist()
            else:
                read = pc.match_substring(values, marks)
                if heads and None in at:
                    head = (heads[key["kind"]], heads[key["kind"]] + "\r")
                    read = pc.or_(read, pc.is_in(values, value_set=pa.array(head, values.type)))
                lines = np.flatnonzero(read.to_numpy(zero_copy_only=False))
                texts = values.take(pa.array(lines)).to_pylist()
                lines = (lines + seen).tolist()
            for line, text in zip(lines, texts):
                for i, (inside, depth, low) in enumerate(state):
                    m, d, least = scan(inside, text + end)
                    state[i] = (m, depth + d, min(low, depth + least))
                    if not inside and not m and at[i] is None and text in head:
                        at[i] = line
            seen += len(values)
        if now:
            rows.append((*now, *state[0], *state[1], *at))
        if rows:
            cols = list(zip(*rows))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=list(_SUMMARY))
    return run


def _starts(summary: DataFrame) -> DataFrame:
    """(f, block, kind, inside, depth, low, head): the state every range starts in, the least depth before it, its header's place."""
    along = Window.partitionBy("f").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when((F.col("m0") == 1) & (F.col("m1") == 0), 1)).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    counted = summary.withColumn("_swaps", swaps)
    fixed = F.last(F.when(F.col("m0") == F.col("m1"), F.struct(F.col("m0").alias("m"), F.col("_swaps").alias("s"))), ignorenulls=True).over(before)
    own = F.coalesce(F.last("_swaps").over(before), F.lit(0))
    inside = F.pmod(F.coalesce(fixed["m"], F.lit(0)) + own - F.coalesce(fixed["s"], F.lit(0)), F.lit(2))
    placed = counted.withColumn("inside", inside)
    change, least = (F.when(F.col("inside") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("d0", "d1"), ("l0", "l1")))
    deep = placed.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0))).withColumn("_least", F.col("depth") + least)
    head = F.col("block") + F.when(F.col("inside") == 0, F.col("h0")).otherwise(F.col("h1"))
    return deep.select("f", "block", "kind", "inside", "depth", F.coalesce(F.min("_least").over(before), F.lit(0)).alias("low"), head.alias("head"))


def _cut(scans: list[Scan], end: str, marks: str):
    """Ranges with their start state -> whole records (part 0) and fragments: 1 head, 2 middle, 3 tail."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, open_at, begun = None, [], 0, False  # begun: the record being read began in this range
        inside = depth = low = line = 0
        out: list[tuple] = []

        def fragment(part: int) -> tuple:
            return (*now, open_at, part, (end or "\n").join(held) + end)

        def batch():
            cols = list(zip(*out))
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string())],
                                   names=["f", "block", "kind", "line", "part", "record"])

        def sliced(values: pa.Array, line: int):
            n = len(values)
            return pa.record_batch([*(pa.array(np.full(n, x, dtype=np.int64)) for x in now), pa.array(np.arange(line, line + n)),
                                    pa.array(np.zeros(n, dtype=np.int64)), values.cast(pa.string())],
                                   names=["f", "block", "kind", "line", "part", "record"])
        for key, b in _by_range(it, ["f", "block", "kind", "inside", "depth", "low"]):
            where = (key["f"], key["block"], key["kind"])
            first = where != now
            if first:
                if held:
                    out.append(fragment(3 if begun else 2))
                now, held, line, open_at = where, [], 0, 0
                inside, depth, low = key["inside"], key["depth"], key["low"]
                begun = not inside and depth == 0
            scan, values = scans[key["kind"]], b.column(b.schema.get_field_index("value"))
            if not end:
                plain = pc.invert(pc.match_substring(values, marks)).to_pylist()
                marked = [*(i for i, x in enumerate(plain) if not x), len(plain)]
            texts, passed, next_mark = values.to_pylist() if end or len(marked) > 1 or inside else None, 0, 0
            for i in range(len(values)):
                if i < passed:
                    continue
                if not end and begun and not held and not inside:  # lines up to the next one with marks are records as they are
                    while marked[next_mark] < i:
                        next_mark += 1
                    k = marked[next_mark] - i
                    if k > SLICED or texts is None:
                        yield sliced(values.slice(i, k), line)
                        line, passed = line + k, i + k
                        continue
                text = texts[i]
                if end and first and i == 0 and key["block"] == 0:
                    text = _ARRAY_HEAD.sub("", text, count=1)
                if not held:
                    open_at = line
                held.append(text)
                line += 1
                if end or not plain[i]:
                    m, d, least = scan(inside, text + end)
                    inside, low, depth = m, min(low, depth + least), depth + d
                if not inside and depth == 0:
                    if low >= 0:  # a JSON array that has closed holds no further elements
                        out.append(fragment(0 if begun else 1))
                    held, begun = [], True
                if len(out) >= 2000:
                    yield batch()
                    out.clear()
        if held:
            out.append(fragment(3 if begun else 2))
        if out:
            yield batch()
    return run


def records(spark: SparkSession, paths: str | list[str], kinds: DataFrame, scans: list[Scan], line_sep: str = "\n", end: str = "",
            marks: str = '"', encoding: str = "UTF-8") -> DataFrame:
    """(f, kind, line_no, record) of the files in ``kinds`` (f, kind): the number of a file's scanner.

    ``line_no`` grows along a file.  ``end`` is what splitting took from the end of every piece (JSON); pieces without
    ``marks`` do not change the state (CSV).
    """
    read = pieces(spark, paths, line_sep, encoding)
    starts = range_starts(read, kinds, scans, end, marks)
    parts = written(cut(read, starts, scans, end, marks), "range-parts")
    whole = parts.where("part = 0").select("f", "kind", line_no(), "record")
    discard(starts)
    out = whole.unionByName(joined(parts.where("part > 0"), end))
    out._written_at = parts._written_at  # for callers that write what they take from the records
    return out


def line_no() -> Column:
    return (F.col("block") + F.col("line")).alias("line_no")  # a line takes a byte at least


def range_starts(read: DataFrame, kinds: DataFrame, scans: list[Scan], end: str = "", marks: str = '"', heads: list[str] = ()) -> DataFrame:
    """The scratch table of all ranges with their start states; with ``heads``, also where each kind's header line stands."""
    # one small row per file and per range, so the text is scanned where it lies, in order, and never dealt by file
    scanned = read.join(F.broadcast(kinds), "f").select("f", "block", "kind", "value")
    return written(_starts(scanned.mapInArrow(_summary(scans, end, marks, heads), ", ".join(f"{c} long" for c in _SUMMARY))), "range-starts")


def cut(read: DataFrame, starts: DataFrame, scans: list[Scan], end: str = "", marks: str = '"') -> DataFrame:
    """(f, block, kind, line, part, record): whole records (part 0) and the fragments at the ends of ranges, for ``joined``."""
    placed = read.join(F.broadcast(starts.drop("head")), ["f", "block"]).select("f", "block", "kind", "inside", "depth", "low", "value")
    return placed.mapInArrow(_cut(scans, end, marks), "f long, block long, kind long, line long, part long, record string")


def joined(fragments: DataFrame, end: str = "") -> DataFrame:
    """(f, kind, line_no, record) of the records that fragments make up."""
    ends = fragments.withColumn("_of", F.sum(F.when(F.col("part") == 3, 1).otherwise(0)).over(
        Window.partitionBy("f").orderBy("block", F.col("part"), "line")))  # of one range its head comes before its tail
    found = ends.groupBy("f", "kind", "_of").agg(F.min(F.col("block") + F.col("line")).alias("line_no"), F.sort_array(F.collect_list(
        F.struct("block", "part", "record"))).alias("_all"), F.max("part").alias("_tail")).where("_tail = 3")
    # what the last range leaves open (a quote that never closes) is a record up to the end of its file
    text = F.array_join(F.transform("_all", lambda x: x["record"]), "" if end else "\n")
    if end:  # but no element: its last piece is what follows the array
        found = found.where(F.exists("_all", lambda x: x["part"] == 1))
    return found.select("f", "kind", "line_no", text.alias("record"))


def first_pieces(read: DataFrame) -> DataFrame:
    """(f, block, value): the first piece of every range in ``read``."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for key, b in _by_range(it, ["f", "block"]):
            if (key["f"], key["block"]) != now:
                now = key["f"], key["block"]
                yield b.slice(0, 1)
    return read.select("f", "block", "value").mapInArrow(run, "f long, block long, value string")


def without_return(record: Column) -> Column:
    return F.when(record.endswith("\r"), F.left(record, F.length(record) - 1)).otherwise(record)


def split(record: Column, width: int, sep: str) -> Column:
    """A record's first ``width`` fields as a struct c0, c1, ...; null where it has fewer."""
    return F.from_csv(record, ", ".join(f"c{i} string" for i in range(width)), {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})


def csv_fields(record_rows: DataFrame, columns: int, sep: str) -> DataFrame:
    """Adds the array ``fields`` of a record's first ``columns`` + 1 fields; the last is null unless there are more than ``columns``."""
    record = without_return(F.col("record"))
    parsed = split(record, columns + 1, sep)
    return record_rows.where(F.length(record) > 0).withColumn("_c", parsed).withColumn(
        "fields", F.array(*[F.col("_c")[f"c{i}"] for i in range(columns + 1)])).drop("_c")


def json_lines(spark: SparkSession, path: str) -> str | None:
    """Deals the elements of JSON documents (an array, or ``data`` / ``results`` holding one) to JSON lines; returns their folder.

    None where a file has another form.
    """
    text = spark.read.option("lineSep", "}").text(path)
    meta = text.metadataColumn("_metadata")
    firsts = text.where(meta["file_block_start"] == 0).select(F.xxhash64(meta["file_path"]).alias("f"), F.monotonically_increasing_id().alias("n"), "value")
    heads = firsts.groupBy("f").agg(F.min_by("value", "n").alias("head"))
    form = F.regexp_extract(F.concat("head", F.lit("}")), r'^\s*(?:\{\s*"(?:data|results)"\s*:\s*)?\[', 0) != ""
    if not heads.agg(F.coalesce(F.min(form), F.lit(False))).first()[0]:
        return None
    kinds = heads.select("f", F.lit(0).cast("long").alias("kind"))
    found = records(spark, path, kinds, [json_scan], line_sep="}", end="}")
    line = F.regexp_replace(F.regexp_replace("record", r"^[\s,]+", ""), r"[\r\n]+", " ")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/json-lines-{uuid.uuid4().hex}"
    found.select(line.alias("value")).where(F.col("value").startswith("{")).write.text(folder)
    return folder
