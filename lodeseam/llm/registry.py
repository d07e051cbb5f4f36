"""The queries of this package, one for each operation, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP4_SQL, op4_exact_dedup
from .katz import op7_lm_score
from .license_scan import OP1_SQL, op1_license_scan
from .mixing import op2_mix_sources
from .packing import op8_best_fit_packing
from .prefix_trie import OP12_SQL, op12_conversation_prefix_trie
from .quality_rules import op9_quality_rules
from .repeats import op13_suffix_array_dedup
from .simhash import op3_simhash_near_dedup
from .token_alignment import op11_cross_tokenizer_alignment
from .token_counts import op5_token_counts
from .toxicity import op10_toxicity
from .url_filter import OP6_SQL, op6_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_mix_sources": op2_mix_sources,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_url_filter": op6_url_filter,
        "op7_lm_score": op7_lm_score,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_quality_rules": op9_quality_rules,
        "op10_toxicity": op10_toxicity,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
        "op13_suffix_array_dedup": op13_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op12_conversation_prefix_trie": OP12_SQL}
