"""All registered queries of this subpackage."""

from wavetally.llm import (  # noqa: F401
    decontamination_query,
    html_text_query,
    language_id_query,
    line_dedup_query,
    ngram_join_query,
    nnls_packing_query,
    packing_query,
    periodic_runs_query,
    quality_classifier_query,
    quality_rules_query,
    token_counts_query,
    token_files_query,
    whitening_query,
)
from wavetally.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
