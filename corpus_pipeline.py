"""A training-corpus pipeline over the documents table.

Five stages, each over everything its predecessor kept:

1. quality: the positive-unlabelled classifier; documents it rejects go.
2. near duplicates: the n-gram Jaccard join; one document of each group stays, the smallest id.  Texts that
   share an id are compared like others; of rows with equal id and text one stays.
3. substrings: relative Lempel-Ziv parsing; repeated passages of 50 words or more are cut, and
   documents of which nothing is left go.
4. mixing: Pfair scheduling by the square root of the sources' sizes; rows in the order of the mix.
5. encoding: sampled SentencePiece segmentations and each row's ``mix_position``, the pipeline's result.

Stages 1 to 4 return the columns of their input.  Rows with a null id pass stages 2 and 3 unchanged.
The mix is the order of the rows in the Parquet files of stage 4; stage 5 reads the places from these files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mercato.llm.common import discard, table, written
from mercato.llm.ngram_join import ngram_jaccard_join
from mercato.llm.pfair import in_mixed_order, with_mix_positions
from mercato.llm.pu_quality import feature_table, good_ids, train
from mercato.llm.rlz import substring_dedup
from mercato.llm.sp_sampling import sampled_encodings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    figures = written(feature_table(docs), "pu-features")
    model = train(figures, good_ids(table(spark, sf_dir, "labels")))
    discard(figures)
    return model.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest id, and of texts that share it the smallest node.

    A document is a node of the join by its id, or where several rows share the id by a hash of id and text, so that
    texts are compared each on its own.  Rows that share id and text are one node; one of them stays.
    """
    known = docs.where("doc_id is not null")
    many = written(known.groupBy(F.col("doc_id").alias("many_id")).count().where("count > 1").select("many_id"), "repeated-ids")
    own = F.xxhash64("row.doc_id", "row.text")
    rows = known.select(F.struct(*docs.columns).alias("row"))
    single, shared = rows.withColumn("node", F.col("row.doc_id").cast("long")), None
    if not many.isEmpty():
        on = F.col("row.doc_id") == F.col("many_id")
        single = single.join(many, on, "left_anti")
        shared = rows.join(many, on, "left_semi").withColumn("node", own).dropDuplicates(["node"])
    nodes = single if shared is None else single.unionByName(shared)
    members, _ = ngram_jaccard_join(nodes.select("node", F.col("row.text").alias("text")), id_col="node")
    placed = members.select(F.col("doc_id").alias("node"), "component_id")
    if shared is None:
        gone = placed.where("node <> component_id").select(F.col("node").alias("gone"))
    else:
        ids = shared.select("node", F.col("row.doc_id").cast("long").alias("real"))
        named = placed.join(ids, "node", "left").withColumn("real", F.coalesce("real", "node"))
        best = named.groupBy("component_id").agg(F.min(F.struct("real", "node")).alias("best"))
        gone = named.join(best, "component_id").where("node <> best.node").select(F.col("node").alias("gone"))
    gone = written(gone, "near-duplicates")
    kept = nodes.join(gone.hint("shuffle_hash"), F.col("node") == F.col("gone"), "left_anti")
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    results, _ = substring_dedup(docs, with_text=True)
    cut = written(results.where("n_removed > 0 and kept_text is not null")
                  .select(F.col("doc_id").alias("cut_id"), F.col("raw").alias("cut_raw"), "kept_text").distinct(), "cut-texts")
    text = F.coalesce("kept_text", "row.text")
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long")))
    return (docs.select(F.struct(*docs.columns).alias("row"))
            .join(cut.hint("shuffle_hash"), (F.col("row.doc_id") == F.col("cut_id")) & (F.xxhash64("row.text") == F.col("cut_raw")), "left")
            .where("kept_text is null or kept_text <> ''").select(row.alias("row")).select("row.*"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled_encodings(with_mix_positions(docs), keep=("mix_position",))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("encoding", encoding)]

#: SQL cannot express the classifier or the sampled segmentations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # the stage's input, unless it is the documents table
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
