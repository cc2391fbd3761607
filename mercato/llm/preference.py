"""Chat formatting of preference pairs (DataFrame operations only).

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; what follows in each
is its completion, with the spans of the assistant's words, the only characters
that are trained on.  Everything else of a completion is masked.

Turns of a conversation are gathered with one shuffle by conversation; a
conversation is a bounded group of turns.  The query pairs every conversation
(chosen) with a copy of itself whose last assistant turn is that of the next
conversation that has one (rejected; the last is followed by the first); a conversation
without an assistant turn is paired with itself.  Next
ids come from a range partitioning of ids: neighbours within a range by a
window, across ranges from each range's first id (one row per partition).

Defined results: turns are ordered by turn number, then role, then text, and exact
repeats of a turn count once.  A null role is rendered as ``unknown``, a null text
as empty.  Rows with a null conversation id belong to no conversation and are
left out.  Equal conversations, so those without an assistant turn in the query too,
give empty completions and ``differs`` false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mercato.llm.common import partitions, table, written

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations_of(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    one = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
                                                 F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = one.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    return gathered.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in both."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """Character spans (start, end) of the assistant's words in the rendered turns, with the end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(head(t))
        end = begin + F.length(t["text"]) + F.lit(len(END))
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """Formats (pair_id, chosen, rejected), two arrays of turns, as prompt and two masked completions."""
    p = pairs.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    for side in ("chosen", "rejected"):
        p = p.withColumn(f"{side}_rest", F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.lit(0), F.size(side) - F.col("prompt_turns"))))
    return p.select(
        "pair_id", "prompt_turns", rendered(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        rendered(F.col("chosen_rest")).alias("chosen"), trained_spans(F.col("chosen_rest")).alias("chosen_trained"),
        rendered(F.col("rejected_rest")).alias("rejected"), trained_spans(F.col("rejected_rest")).alias("rejected_trained"),
        ((F.size("chosen_rest") > 0) | (F.size("rejected_rest") > 0)).alias("differs"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) over distinct ids, the last followed by the first; no task sees more than its range."""
    spark = ids.sparkSession
    placed = written(ids.distinct().repartitionByRange(partitions(spark), "id").withColumn("part", F.spark_partition_id()), "id-ranges")
    lows = sorted((r.part, r.low) for r in placed.groupBy("part").agg(F.min("id").alias("low")).collect())  # one row per partition
    if not lows:
        return placed.select("id", F.col("id").alias("next_id"))
    after = spark.createDataFrame([(p, lows[(i + 1) % len(lows)][1]) for i, (p, _) in enumerate(lows)], "part int, following long")
    lead = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return (placed.withColumn("lead", lead).join(F.broadcast(after), "part")
            .select("id", F.coalesce("lead", "following").alias("next_id")))


def edited_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) of every conversation: rejected has the next one's last assistant turn in place of its own."""
    convs = written(conversations_of(turns), "conversations")
    last = F.expr(f"size(turns) - array_position(transform(reverse(turns), t -> t.role = '{TRAINED}'), true)").cast("int")
    answered = F.exists("turns", lambda t: t["role"] == TRAINED)
    own = convs.withColumn("at", last).where(answered)
    replies = own.select(F.col("conv_id").alias("next_id"), F.get("turns", F.col("at")).alias("reply"))
    nexts = next_ids(own.select(F.col("conv_id").cast("long").alias("id")))
    edited = (own.join(nexts, own["conv_id"] == nexts["id"]).join(replies, "next_id")
              .select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
                      F.transform("turns", lambda t, i: F.when(i == F.col("at"), F.col("reply")).otherwise(t)).alias("rejected")))
    same = convs.where(~answered).select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.col("turns").alias("rejected"))
    return edited.unionByName(same)


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation against its edited copy."""
    out = preference_pairs(edited_pairs(table(spark, sf_dir, "conversations")))
    for side in ("chosen_trained", "rejected_trained"):  # spans as text, "start-end" joined by blanks
        out = out.withColumn(side, F.array_join(F.transform(side, lambda x: F.concat_ws("-", x["start"], x["end"])), " "))
    return out


# DuckDB: the same pairs and spans.
OP9_SQL = r"""
with t as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i, count(*) over (partition by conv_id) as size from t),
l as (select conv_id, max(i) as pos from n where role = 'assistant' group by conv_id),
r as (select l.conv_id, l.pos, n.role, n.text from l join n on n.conv_id = l.conv_id and n.i = l.pos),
x as (select conv_id, coalesce(lead(conv_id) over (order by conv_id), min(conv_id) over ()) as next_id from r),
p as (select n.conv_id as pair_id, n.i, n.role, n.text, case when n.i = r.pos then o.text else n.text end as other, r.pos, n.size
      from n join r using (conv_id) join x using (conv_id) join r o on o.conv_id = x.next_id
      union all select conv_id, i, role, text, text, -1, size from n where conv_id not in (select conv_id from l)),
c as (select pair_id, max(case when pos < 0 or (i = pos and text = other) then size else pos end) as k from p where i = pos or pos < 0 group by pair_id),
s as (select p.*, c.k, '<|' || role || '|>' || chr(10) as head from p join c using (pair_id)),
z as (select *, coalesce(sum(case when i >= k then length(head) + length(text) + 8 else 0 end) over w, 0)::int as a,
        coalesce(sum(case when i >= k then length(head) + length(other) + 8 else 0 end) over w, 0)::int as b
      from s window w as (partition by pair_id order by i rows between unbounded preceding and 1 preceding))
select pair_id, any_value(k)::int as prompt_turns,
  coalesce(string_agg(head || text || '<|end|>' || chr(10), '' order by i) filter (where i < k), '') as prompt,
  coalesce(string_agg(head || text || '<|end|>' || chr(10), '' order by i) filter (where i >= k), '') as chosen,
  coalesce(string_agg((a + length(head)) || '-' || (a + length(head) + length(text) + 8), ' ' order by i) filter (where i >= k and role = 'assistant'), '') as chosen_trained,
  coalesce(string_agg(head || other || '<|end|>' || chr(10), '' order by i) filter (where i >= k), '') as rejected,
  coalesce(string_agg((b + length(head)) || '-' || (b + length(head) + length(other) + 8), ' ' order by i) filter (where i >= k and role = 'assistant'), '') as rejected_trained,
  any_value(k) < any_value(size) as differs
from z group by pair_id
"""
