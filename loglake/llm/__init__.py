"""Operations of a training-data pipeline; ``QUERIES`` and ``ORACLES`` by name."""

from loglake.llm import (
    decontaminate,
    html_extract,
    lexical_search,
    line_dedup,
    ngram_join,
    periodic_runs,
    pii,
    quality_neighbours,
    quality_rules,
    sentencepiece_dropout,
    simhash_join,
    substring_dedup,
    token_counts,
)

QUERIES = {f.__name__: f for f in (
    token_counts.op1_token_counts,
    ngram_join.op2_ngram_jaccard,
    substring_dedup.op3_substring_dedup,
    quality_rules.op4_quality_rules,
    line_dedup.op5_line_dedup,
    sentencepiece_dropout.op6_sentencepiece,
    pii.op7_pii_surrogates,
    decontaminate.op8_decontaminate,
    html_extract.op9_html_extract,
    quality_neighbours.op10_quality_neighbours,
    lexical_search.op11_lexical_search,
    simhash_join.op12_simhash,
    periodic_runs.op13_periodic_runs,
)}
ORACLES = {"op4_quality_rules": quality_rules.ORACLE, "op5_line_dedup": line_dedup.ORACLE,
           "op11_lexical_search": lexical_search.ORACLE, "op13_periodic_runs": periodic_runs.ORACLE}
