"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from mercato.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from mercato.llm.fingerprints import op1_gear_fingerprints
from mercato.llm.line_dedup import OP12_SQL, op12_line_dedup
from mercato.llm.line_rules import OP6_SQL, op6_line_rules
from mercato.llm.ngram_join import op4_ngram_jaccard_join
from mercato.llm.pfair import op7_pfair_mixing
from mercato.llm.preference import OP9_SQL, op9_preference_format
from mercato.llm.pu_quality import op2_pu_quality
from mercato.llm.rlz import op10_substring_dedup
from mercato.llm.sharding import op8_virtual_slots
from mercato.llm.sp_sampling import op5_gumbel_sentencepiece
from mercato.llm.zone_clusters import OP11_SQL, op11_zone_clusters
from mercato.llm.zstd_toxicity import op3_zstd_toxicity

_QUERIES = (op4_ngram_jaccard_join, op10_substring_dedup, op7_pfair_mixing, op8_virtual_slots, op6_line_rules, op2_pu_quality, op3_zstd_toxicity,
            op1_gear_fingerprints, op5_gumbel_sentencepiece, op9_preference_format, op11_zone_clusters, op12_line_dedup, op13_conversation_repair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op6_line_rules": OP6_SQL, "op9_preference_format": OP9_SQL, "op11_zone_clusters": OP11_SQL, "op12_line_dedup": OP12_SQL,
            "op13_conversation_repair": OP13_SQL} | own
