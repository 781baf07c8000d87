"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from . import decontaminate, url_rules
from .decontaminate import op7_decontaminate
from .embedding_dedup import op6_embedding_dedup
from .jaccard_join import op10_jaccard_join
from .lm_score import op2_lm_score
from .pii import op1_pii
from .source_mix import op4_source_mix
from .substring_dedup import op8_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op3_toxicity
from .url_rules import op9_url_filter

QUERIES = {f.__name__: f for f in (op1_pii, op2_lm_score, op3_toxicity, op4_source_mix, op5_suffix_dedup, op6_embedding_dedup, op7_decontaminate, op8_substring_dedup, op9_url_filter, op10_jaccard_join)}

ORACLES: dict[str, str] = {"op7_decontaminate": decontaminate.SQL, "op9_url_filter": url_rules.SQL}
