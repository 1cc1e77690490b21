"""Queries over the given tables and the SQL twins of those that SQL can express."""

from jobatlas.llm import bpe_automaton, conversations, decontaminate, jaccard_join, language_id, merkle, packing, quality_classifier, quality_rules, secret_scan, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_language_id": language_id.op5_language_id,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_warc": warc.op8_warc,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_bpe_codec": bpe_automaton.op13_bpe_codec,
}
ORACLES = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_jaccard_join": jaccard_join.OP2_SQL,
    "op3_secret_scan": secret_scan.OP3_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_suffix_dedup": suffix_dedup.OP9_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
