"""Every query of the corpus operators, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from corpus_pipeline import run

from .collocations import op11_collocations
from .decontam import op10_decontaminate
from .gru_lm import op4_lm_score
from .langid import op9_language_id
from .lexical import op13_lexical_search
from .mixing import op8_mix_sources
from .ngram_join import op3_ngram_join
from .oracle import ORACLE_SQL
from .pii import op1_sanitise_pii
from .quality import op5_quality_rules
from .rp_forest import op12_embedding_near_dedup
from .token_scan import op6_token_counts
from .toxicity import op2_toxicity
from .urls import op7_url_filter

QUERIES = {f.__name__: f for f in (op1_sanitise_pii, op2_toxicity, op3_ngram_join, op4_lm_score, op5_quality_rules, op6_token_counts, op7_url_filter, op8_mix_sources, op9_language_id, op10_decontaminate, op11_collocations, op12_embedding_near_dedup, op13_lexical_search)}
QUERIES["pipeline"] = run

