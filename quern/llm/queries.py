"""Queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP2_SQL, op2_exact_dedup
from .licences import OP5_SQL, op5_licences
from .main_text import op1_main_text
from .mixing import op3_mixing
from .piece_codec import op6_piece_codec
from .pivot_dedup import op7_pivot_dedup
from .shingle_join import op8_shingle_join
from .token_counts import op10_token_counts
from .tool_calls import OP9_SQL, op9_tool_calls
from .toxicity import op4_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_main_text": op1_main_text,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_mixing": op3_mixing,
        "op4_toxicity": op4_toxicity,
        "op5_licences": op5_licences,
        "op6_piece_codec": op6_piece_codec,
        "op7_pivot_dedup": op7_pivot_dedup,
        "op8_shingle_join": op8_shingle_join,
        "op9_tool_calls": op9_tool_calls,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_licences": OP5_SQL, "op9_tool_calls": OP9_SQL}
