"""Queries and oracles of the training-data operators."""

from . import chat_format, decontaminate, exact_dedup, gru_lm, language_id, mixing, near_vectors, ngram_join, secrets, spelling, suffix_dedup, toxicity, vector_codes

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_gru_lm": gru_lm.op6_gru_lm,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_near_vectors": near_vectors.op12_near_vectors,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_near_vectors": near_vectors.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
