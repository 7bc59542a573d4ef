"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from .best_fit_packing import op9_best_fit_packing
from .chat_formatting import OP6_SQL, op6_chat_formatting
from .fingerprints import op4_fingerprints
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .language_id import op13_language_id
from .lm_scoring import op3_lm_scoring
from .periodic_runs import OP11_SQL, op11_periodic_runs
from .piece_codec import op2_piece_codec
from .quality_classifier import op8_quality_classifier
from .quality_rules import OP10_SQL, op10_quality_rules
from .source_divergence import OP12_SQL, op12_source_divergence
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_counts import op7_token_counts

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_piece_codec, op3_lm_scoring, op4_fingerprints, op5_jaccard_join, op6_chat_formatting, op7_token_counts, op8_quality_classifier, op9_best_fit_packing, op10_quality_rules, op11_periodic_runs, op12_source_divergence, op13_language_id)}
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op5_jaccard_join": OP5_SQL, "op6_chat_formatting": OP6_SQL, "op10_quality_rules": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_source_divergence": OP12_SQL}
