"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from corvane.llm.decontamination import OP5_SQL, op5_decontamination
from corvane.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from corvane.llm.jaccard import op9_jaccard_join
from corvane.llm.line_dedup import op8_line_dedup
from corvane.llm.nearest import op4_nearest
from corvane.llm.packing import op7_packing
from corvane.llm.ppm import op3_lm_score
from corvane.llm.secret_ledger import OP13_SQL, op13_secret_ledger
from corvane.llm.sharding import op10_sharding
from corvane.llm.spelling import OP12_SQL, op12_spelling
from corvane.llm.token_output import op1_token_output
from corvane.llm.toxicity import op6_toxicity
from corvane.llm.url_filter import OP2_SQL, op2_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_url_filter": op2_url_filter,
        "op3_lm_score": op3_lm_score,
        "op4_nearest": op4_nearest,
        "op5_decontamination": op5_decontamination,
        "op6_toxicity": op6_toxicity,
        "op7_packing": op7_packing,
        "op8_line_dedup": op8_line_dedup,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_sharding": op10_sharding,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_spelling": op12_spelling,
        "op13_secret_ledger": op13_secret_ledger,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op5_decontamination": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_spelling": OP12_SQL, "op13_secret_ledger": OP13_SQL}
