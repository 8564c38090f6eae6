"""Queries of the operators over whole tables, and SQL twins where SQL can express them."""

from weekloom.llm.decontaminate import OP2_SQL, op2_decontaminate
from weekloom.llm.filter_audit import OP13_SQL, op13_filter_audit
from weekloom.llm.importance import OP12_SQL, op12_importance_resampling
from weekloom.llm.kd_shards import op8_kd_shards
from weekloom.llm.language import op4_language
from weekloom.llm.licenses import op3_licenses
from weekloom.llm.line_rules import OP10_SQL, op10_line_rules
from weekloom.llm.packing import op5_packing
from weekloom.llm.quality_model import op9_quality_fm
from weekloom.llm.repeats import op6_suffix_dedup
from weekloom.llm.secret_scans import op11_secret_scans
from weekloom.llm.simhash import op1_simhash
from weekloom.llm.token_counts import op7_token_counts

QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_decontaminate, op3_licenses, op4_language, op5_packing,
    op6_suffix_dedup, op7_token_counts, op8_kd_shards, op9_quality_fm,
    op10_line_rules, op11_secret_scans, op12_importance_resampling, op13_filter_audit)}

ORACLES = {"op2_decontaminate": OP2_SQL, "op10_line_rules": OP10_SQL,
           "op12_importance_resampling": OP12_SQL, "op13_filter_audit": OP13_SQL}
