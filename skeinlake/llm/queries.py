"""The registered queries of the training-data operators."""

from __future__ import annotations

from . import class_lm, decontaminate, fm, langid, merkle, packing, quality_rules, secrets, sharding, simhash, token_rollup, toxicity, vector_codes

QUERIES = {
    "op1_langid": langid.op1_query,
    "op2_secret_scan": secrets.op2_query,
    "op3_packing": packing.op3_query,
    "op4_simhash": simhash.op4_query,
    "op5_token_rollup": token_rollup.op5_query,
    "op6_decontaminate": decontaminate.op6_query,
    "op7_toxicity": toxicity.op7_query,
    "op8_sharding": sharding.op8_query,
    "op9_quality_rules": quality_rules.op9_query,
    "op10_factorisation_machine": fm.op10_query,
    "op11_class_lm": class_lm.op11_query,
    "op12_vector_codes": vector_codes.op12_query,
    "op13_merkle_manifest": merkle.op13_query,
}
ORACLES: dict[str, str] = {"op5_token_rollup": token_rollup.OP5_SQL, "op12_vector_codes": vector_codes.OP12_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
