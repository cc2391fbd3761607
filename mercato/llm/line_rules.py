"""Quality rules, line first (DataFrame operations only).

Each line of a text is judged on its own; a line with words fails as

* navigation: at least three separators (``|``, ``>``, ``»``, ``·``) standing for a third of its
  tokens or more;
* bad punctuation: more than half of its words carry a symbol of ``#*$%&|<>{}~^`` or
  end in ``!!``;
* shouting: four or more words with ten or more letters and none in lower case;
* boilerplate: it holds one of the phrases below.

Failing lines are removed.  A document is rejected when the removed lines hold more
than ``max_lost`` of its word characters, or when it fails a base rule (under
``MIN_WORDS`` words, or more than half its words in repeated 3-word windows).

All work is done per row in one projection over the scan: no shuffle, no join, no
state.  Repeated windows are found by sorting a text's (window hash, place) pairs.

Defined results: a null text has no words and no lines and fails the base rule.
Lines without a word are never counted, failed or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mercato.llm.common import table

MIN_WORDS = 50
MAX_LOST = 0.3
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

# Phrases of web boilerplate, lower case.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
               "use cookies", "lorem ipsum", "javascript is disabled", "enable javascript", "subscribe to our newsletter",
               "skip to content", "click here to", "share on facebook", "share on twitter", "log in to", "powered by wordpress")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text."""
    def from_hashes(hashes: Column) -> Column:
        keyed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("at")))

        def repeated(k: Column) -> Column:
            marked = F.transform(k, lambda x, i: F.when((F.get(k, i - 1)["h"] == x["h"]) | (F.get(k, i + 1)["h"] == x["h"]), x["at"]))
            return F.sort_array(F.array_compact(marked))

        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                               F.lit(0), lambda a, x: a + x)
        # most texts repeat nothing: then the distinct hashes are as many
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(keyed, repeated), total))

    def windows(ws: Column) -> Column:
        return F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, lambda ws: let(windows(ws), from_hashes)))


def line_fails(line: Column, has_phrase: Column) -> Column:
    """``has_phrase``: whether the whole text holds a boilerplate phrase; costlier tests run only where they can fail."""
    def by_words(parts: Column) -> Column:
        n = F.size(parts)
        separators = F.size(F.filter(parts, lambda w: w.isin("|", ">", "»", "·")))
        marked = F.size(F.filter(parts, lambda w: w.rlike("[#*$%&|<>{}~^]|!!$")))
        return ((separators >= F.greatest(F.lit(3), F.ceil(n / 3))) | (marked * 2 > n)
                | ((n >= 4) & (line == F.upper(line)) & (F.length(F.regexp_replace(line, "[^\\p{L}]+", "")) >= 10)))
    odd = line.rlike("[#*$%&|<>{}~^»·]|!!") | ((line == F.upper(line)) & (line != F.lower(line)))
    return (odd & let(words_of(line), by_words)) | (has_phrase & F.lower(line).rlike("|".join(BOILERPLATE)))


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def judged(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Adds the base figures, n_lines_removed, lost_chars, clean_text, base_failed and kept to every row.

    Columns of the input with these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    out = docs.withColumn("_words", words_of(text)).withColumn("_lines", lines_of(text)).withColumn("_phrase", phrase)
    out = out.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x, F.col("_phrase"))))
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", word_chars(F.col("_words")))
    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("n_repeat_words", n_repeat_words(F.col("_words")).cast("long"))
    out = out.withColumn("n_lines_removed", (F.size("_lines") - F.size("_good")).cast("long"))
    out = out.withColumn("clean_text", F.array_join("_good", "\n"))
    out = out.withColumn("lost_chars", F.when(F.col("n_lines_removed") == 0, F.lit(0)).otherwise(
        F.col("word_chars") - word_chars(words_of(F.col("clean_text")))).cast("long"))
    out = out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * max_lost))
    return out.drop("_words", "_lines", "_phrase", "_good")


def cleaned(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with their failing lines removed, in the input's columns."""
    figures = judged(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")), "text", max_lost)
    return figures.where("kept").select(F.col("row").withField(text_col, F.col("clean_text")).alias("row")).select("row.*")


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the line-first verdict of every document."""
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "n_lines_removed", "lost_chars")


# DuckDB: the same rules over the same texts.
OP6_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select doc_id, unnest(range(0, len(ws) - 2)) as i, ws from w where len(ws) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, ws[i + 1], ws[i + 2], ws[i + 3]) as c from g),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from h where c > 1) group by doc_id),
l as (select doc_id, lines, ws, text,
        list_filter(lines, lambda x: not (
            (len(list_filter(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda y: y in ('|', '>', '»', '·'))) >= 3
             and 3 * len(list_filter(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda y: y in ('|', '>', '»', '·')))
                 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
            or 2 * len(list_filter(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda y: regexp_matches(y, '[#*$%&|<>{}~^]|!!$')))
                 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
            or (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 4
                and length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 10 and x = upper(x) and x <> lower(x))
            or regexp_matches(lower(x), 'BOILERPLATE'))) as good from w),
f as (select doc_id, len(ws)::bigint as n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        (len(lines) - len(good))::bigint as n_lines_removed,
        (length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))
         - length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]', '', 'g')))::bigint as lost_chars from l),
j as (select f.*, coalesce(r.n, 0)::bigint as n_repeat_words from f left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, lost_chars,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars <= word_chars * 0.3) as kept
from j
""".replace("BOILERPLATE", "|".join(BOILERPLATE))
