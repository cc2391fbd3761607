import random

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
PASSAGE = " ".join(f"shared{i}" for i in range(60))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns whose names the operators use themselves
    T.StructField("score", T.DoubleType()), T.StructField("component", T.LongType()), T.StructField("slot", T.StringType()),
    T.StructField("rep", T.LongType()), T.StructField("row", T.StringType()), T.StructField("kept_text", T.StringType())])


def rows():
    rnd = random.Random(5)
    texts = [None, "", "   \n\t ", "word", "Two words", BASE, BASE.upper(), BASE + " end", LONG, LONG + " tail", "é ▁ あ\U0001f600 z\x0bq",
             PASSAGE, "before " + PASSAGE + " after", "other " * 3 + PASSAGE, "A\nA\nB\nA", "Is onhe. " * 120, BASE, BASE]
    texts += [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rnd.randrange(1, 90))) for _ in range(12)]
    out = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(5, BASE, "en", "s0", len(BASE)), (5, BASE, "en", "s0", len(BASE)), (5, "same id, other text", "en", "s0", 19)]
    out += [(None, BASE, None, None, None), (None, None, None, None, None)]
    return [(*r, 0.5, 7, "x", 3, "r", "k") for r in out]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
