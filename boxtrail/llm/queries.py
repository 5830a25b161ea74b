"""The queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from boxtrail.llm.op1_merkle_audit import OP1_SQL, op1_merkle_audit
from boxtrail.llm.op2_byte_bpe import op2_byte_bpe
from boxtrail.llm.op3_winnowing import OP3_SQL, op3_winnowing
from boxtrail.llm.op4_minhash_forest import OP4_SQL, op4_minhash_forest
from boxtrail.llm.op5_maxent_lm import op5_maxent_lm
from boxtrail.llm.op6_byte_gru import op6_byte_gru
from boxtrail.llm.op7_sparse_suffixes import OP7_SQL, op7_sparse_suffixes
from boxtrail.llm.op8_likelihood_ratio import op8_likelihood_ratio
from boxtrail.llm.op9_url_rules import OP9_SQL, op9_url_rules
from boxtrail.llm.op10_license_index import OP10_SQL, op10_license_index
from boxtrail.llm.op11_spelling_groups import OP11_SQL, op11_spelling_groups
from boxtrail.llm.op12_merkle_manifest import OP12_SQL, op12_merkle_manifest
from boxtrail.llm.op13_phrase_automata import OP13_SQL, op13_phrase_automata

QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        op1_merkle_audit,
        op2_byte_bpe,
        op3_winnowing,
        op4_minhash_forest,
        op5_maxent_lm,
        op6_byte_gru,
        op7_sparse_suffixes,
        op8_likelihood_ratio,
        op9_url_rules,
        op10_license_index,
        op11_spelling_groups,
        op12_merkle_manifest,
        op13_phrase_automata,
    )
}
ORACLES: dict[str, str] = {
    "op1_merkle_audit": OP1_SQL,
    "op3_winnowing": OP3_SQL,
    "op4_minhash_forest": OP4_SQL,
    "op7_sparse_suffixes": OP7_SQL,
    "op9_url_rules": OP9_SQL,
    "op10_license_index": OP10_SQL,
    "op11_spelling_groups": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_phrase_automata": OP13_SQL,
}
