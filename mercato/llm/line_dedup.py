"""Line dedup over range-partitioned line hashes (DataFrame operations only).

A line's key is the line without blanks at its ends, A-Z lower-cased.  Keys of ``min_chars`` code
points or more that stand in ``min_docs`` documents or more are dropped everywhere but in the
largest document holding them.

1.  One pass over the texts writes, per row, its line count and for each long enough line a 128-bit
    key hash and the line's position.  Texts are not needed again to decide anything.
2.  A frequency sketch (a fixed number of counters) names the hashes that hold more than one in
    ``HOT`` rows, at most ``HOT`` of them.  Their documents are counted and their largest document
    found by aggregates that combine before the shuffle, and the few answers go back to the rows by
    a broadcast join of at most about ``HOT`` rows.
3.  All other rows are range-partitioned by hash and sorted by document (largest first) and
    position.  Windows stream over each key: the first row holds the surviving document, a change of
    document counts one.  The ranges serve the windows, so rows are shuffled once.
4.  The dropped positions of a document come together as a run-length compressed bitmap: the runs
    (first, last) of dropped lines; all other lines are kept.

Which hashes count as hot decides where a key is settled, never how.

Defined results: a null or empty text is one empty line.  A document is a doc_id: rows that share an
id count as one document and keep a surviving line in each of them, but each has its own bitmap.
Rows with a null id count for nothing and never hold the surviving line; they lose what ``min_docs``
documents with an id hold.  Repeated rows get equal results.  Keys are compared by their 128-bit
hashes.  An empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mercato.llm.common import partitions, table, written

MIN_CHARS = 20
MIN_DOCS = 3
HOT = 1000  # a hash with more than one in HOT rows is hot
TRACKED = 16384  # counters of the frequency sketch; its error is below one in 4000 rows
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def row_hash(id_col: str, text_col: str) -> Column:
    """Tells rows that share an id apart by their text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, row, and keys: the hash and position of every line long enough to be dropped."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = F.transform(lines_of(folded(body)), lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("key"), i.alias("pos")))
    keys = F.transform(F.filter(keys, lambda x: F.length(x["key"]) >= min_chars), lambda x: F.struct(
        F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(min_chars), x["key"]).alias("h2"), x["pos"].alias("pos")))
    return docs.select(F.col(id_col).cast("long").alias("doc"), row_hash(id_col, text_col).alias("row"), keys.alias("keys"))


def _runs(positions: Column) -> Column:
    """Runs (first, last) of sorted distinct positions."""
    firsts = F.filter(positions, lambda x, i: (i == 0) | (F.get(positions, i - 1) < x - 1))
    lasts = F.filter(positions, lambda x, i: (i == F.size(positions) - 1) | (F.get(positions, i + 1) > x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row, n_dropped and bitmap of every row that loses lines; ``row`` is ``row_hash`` of the id and text."""
    spark = docs.sparkSession
    keyed = written(keyed_lines(docs, id_col, text_col, min_chars), "line-keys")
    rows = keyed.select("doc", "row", F.explode("keys").alias("k")).select("k.h1", "k.h2", "doc", "row", "k.pos")

    # a sketch of fixed size: at most HOT of its items hold more than one in HOT rows
    seen = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {HOT}, {TRACKED})").alias("top")).first()
    often = [x["item"] for x in seen["top"] or [] if x["count"] * HOT > seen["n"]]
    hot = spark.createDataFrame([(h,) for h in often], "h1 long")

    held = rows.join(F.broadcast(hot), "h1")
    tops = (held.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).where("doc is not null")
            .groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= min_docs))
    lost = held.join(F.broadcast(tops), ["h1", "h2"]).where("doc is null or doc <> top").select("doc", "row", "pos")

    ranged = rows.join(F.broadcast(hot), "h1", "left_anti").repartitionByRange(partitions(spark), "h1", "h2")
    key = Window.partitionBy("h1", "h2")
    order = key.orderBy(F.col("doc").desc_nulls_last(), "row", "pos")
    begins = F.col("doc").isNotNull() & F.coalesce(F.lag("doc").over(order) != F.col("doc"), F.lit(True))
    streamed = (ranged.select("*", F.first("doc").over(order).alias("top"), begins.cast("int").alias("begins"))
                .withColumn("docs", F.sum("begins").over(key)))
    lost = lost.unionByName(streamed.where((F.col("docs") >= min_docs) & F.expr("doc is null or doc <> top")).select("doc", "row", "pos"))

    gathered = lost.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    return gathered.select("doc", "row", F.size("positions").cast("long").alias("n_dropped"), _runs(F.col("positions")).alias("bitmap"))


def kept_text(lines: Column, bitmap: Column) -> Column:
    """The lines outside the bitmap's runs, joined again; all of them where there is no bitmap."""
    def between(k: Column) -> Column:
        first = F.when(k == 0, 0).otherwise(F.get(bitmap, k - 1)["last"] + 1)
        end = F.when(k == F.size(bitmap), F.size(lines)).otherwise(F.get(bitmap, k)["first"])
        return F.slice(lines, first + 1, end - first)
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(bitmap)), between)), "\n")


def line_deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row."""
    lost = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                        row_hash(id_col, text_col).alias("of_row"))
    joined = texts.join(lost, (F.col("of_row") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    lines = lines_of(F.col("text"))
    text = F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(kept_text(lines, F.col("bitmap")))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), text.alias("kept_text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the hash of the kept text of every document."""
    out = line_deduped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP12_SQL = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from l),
m as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, m.key is not null and k.doc_id is distinct from m.top as gone from k left join m on m.key = k.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by r
"""
