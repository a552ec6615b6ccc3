"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stationwise.llm.decontamination import OP11_SQL, op11_decontamination
from stationwise.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from stationwise.llm.language_id import op1_language_id
from stationwise.llm.line_dedup import op9_line_dedup
from stationwise.llm.lm_scoring import op8_lm_scoring
from stationwise.llm.mixing import op3_mixing
from stationwise.llm.near_dedup import OP5_SQL, op5_near_dedup
from stationwise.llm.packing import op7_packing
from stationwise.llm.pii import op10_pii
from stationwise.llm.quality_rules import op2_quality_rules
from stationwise.llm.vector_codes import op13_vector_codes
from stationwise.llm.warc import OP6_SQL, op6_warc_revisit
from stationwise.llm.whitening import op12_whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_language_id,
        op2_quality_rules,
        op3_mixing,
        op4_exact_dedup,
        op5_near_dedup,
        op6_warc_revisit,
        op7_packing,
        op8_lm_scoring,
        op9_line_dedup,
        op10_pii,
        op11_decontamination,
        op12_whitening,
        op13_vector_codes,
    )
}

STATEMENTS: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op5_near_dedup": OP5_SQL,
    "op6_warc_revisit": OP6_SQL,
    "op11_decontamination": OP11_SQL,
}
