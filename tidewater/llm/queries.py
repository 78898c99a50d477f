"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.backoff import op6_stupid_backoff
from tidewater.llm.bpe import op7_byte_bpe
from tidewater.llm.embedding_dedup import op3_embedding_dedup
from tidewater.llm.fill_in_middle import SQL as FILL_IN_MIDDLE_SQL
from tidewater.llm.fill_in_middle import op11_fill_in_middle
from tidewater.llm.importance import SQL as IMPORTANCE_SQL
from tidewater.llm.importance import op13_importance_resampling
from tidewater.llm.packing import op4_best_fit_packing
from tidewater.llm.pii import op8_pii
from tidewater.llm.quality import op5_quality_rules
from tidewater.llm.simhash import op9_simhash_dedup
from tidewater.llm.substring_dedup import op2_substring_dedup
from tidewater.llm.suffix_dedup import op1_suffix_dedup
from tidewater.llm.toxicity import op10_toxicity
from tidewater.llm.warc import SQL as WARC_SQL
from tidewater.llm.warc import op12_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_stupid_backoff": op6_stupid_backoff,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pii": op8_pii,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_warc": op12_warc,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op11_fill_in_middle": FILL_IN_MIDDLE_SQL,
    "op12_warc": WARC_SQL,
    "op13_importance_resampling": IMPORTANCE_SQL,
}
