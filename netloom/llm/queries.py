"""Registered queries of the training-data operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from netloom.llm import op2_decontaminate, op12_bag_rank
from netloom.llm.op10_brown import op10_brown
from netloom.llm.op11_license_templates import op11_license_templates
from netloom.llm.op13_whitening import op13_whitening
from netloom.llm.op1_substring_dedup import op1_substring_dedup
from netloom.llm.op3_cross_polytope import op3_cross_polytope
from netloom.llm.op4_quality import op4_quality
from netloom.llm.op5_training_order import op5_training_order
from netloom.llm.op6_toxicity import op6_toxicity
from netloom.llm.op7_bagminhash import op7_bagminhash
from netloom.llm.op8_token_counts import op8_token_counts
from netloom.llm.op9_mixture import op9_mixture

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate.op2_decontaminate, op3_cross_polytope, op4_quality, op5_training_order, op6_toxicity, op7_bagminhash, op8_token_counts, op9_mixture, op10_brown, op11_license_templates, op12_bag_rank.op12_bag_rank, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": op2_decontaminate.ORACLE, "op12_bag_rank": op12_bag_rank.ORACLE}
