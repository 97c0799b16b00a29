"""Registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import ball_search, collocations, decontam, exact_dedup, langid, mixing, ngram_join, pieces, ppm, quality, quotes, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_ngram_join": ngram_join.op2,
    "op3_quote_links": quotes.op3,
    "op4_quality_rules": quality.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_ppm": ppm.op6,
    "op7_pieces": pieces.op7,
    "op8_language_id": langid.op8,
    "op9_token_files": token_files.op9,
    "op10_mix_sources": mixing.op10,
    "op11_collocations": collocations.op11,
    "op12_decontaminate": decontam.op12,
    "op13_ball_search": ball_search.op13,
}

ORACLES = {
    "op2_ngram_join": ngram_join.ORACLE_OP2,
    "op4_quality_rules": quality.ORACLE_OP4,
    "op5_exact_dedup": exact_dedup.ORACLE_OP5,
    "op10_mix_sources": mixing.ORACLE_OP10,
    "op11_collocations": collocations.ORACLE_OP11,
    "op12_decontaminate": decontam.ORACLE_OP12,
    "op13_ball_search": ball_search.ORACLE_OP13,
}
