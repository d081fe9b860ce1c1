"""Registered queries of the operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from churnlens.llm.lexical import ORACLE as LEXICAL_SQL
from churnlens.llm.lexical import op12_lexical_search
from churnlens.llm.mixing import ORACLE as MIX_SQL
from churnlens.llm.mixing import op4_mix_sources
from churnlens.llm.packing import op3_best_fit_packing
from churnlens.llm.pii import op2_personal_data
from churnlens.llm.quality_fm import op8_quality_fm
from churnlens.llm.rules import op10_quality_rules
from churnlens.llm.secret_scan import op5_secret_scan
from churnlens.llm.simhash import op7_simhash_bk_tree
from churnlens.llm.spelling import op11_spelling_variants
from churnlens.llm.token_cache import op13_token_counts
from churnlens.llm.token_files import op1_token_files
from churnlens.llm.topk import op9_top_k
from churnlens.llm.wrappers import op6_page_wrappers

QUERIES = {f.__name__: f for f in (op1_token_files, op2_personal_data, op3_best_fit_packing, op4_mix_sources,
                                   op5_secret_scan, op6_page_wrappers, op7_simhash_bk_tree, op8_quality_fm, op9_top_k, op10_quality_rules,
                                   op11_spelling_variants, op12_lexical_search, op13_token_counts)}
ORACLES = {"op4_mix_sources": MIX_SQL, "op12_lexical_search": LEXICAL_SQL}
