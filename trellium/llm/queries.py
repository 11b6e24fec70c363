"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_format
from .decontamination import OP1_SQL, op1_benchmark_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .language_id import op6_language_id
from .near_dedup import op9_near_dedup
from .packing import op4_best_fit_packing
from .quality import op2_quality
from .sharding import op3_feistel_shards
from .suffix_dedup import op7_suffix_array_dedup
from .toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_quality,
        op3_feistel_shards,
        op4_best_fit_packing,
        op5_chat_format,
        op6_language_id,
        op7_suffix_array_dedup,
        op8_exact_dedup,
        op9_near_dedup,
        op10_toxicity,
    )
}
ORACLES = {"op1_benchmark_decontamination": OP1_SQL, "op5_chat_format": OP5_SQL, "op8_exact_dedup": OP8_SQL}
