"""The queries of the training-data operators by name, and SQL that gives their rows."""

from . import archives, curriculum, decontaminate, jaccard, language, licences, pivots, quality, substrings, tokens

QUERIES = {
    "op1_token_length_histogram": tokens.op1_token_length_histogram,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_curriculum_mix": curriculum.op3_curriculum_mix,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_language_id": language.op5_language_id,
    "op6_template_decontamination": decontaminate.op6_template_decontamination,
    "op7_licence_scan": licences.op7_licence_scan,
    "op8_warc_round_trip": archives.op8_warc_round_trip,
    "op9_importance_resampling": quality.op9_importance_resampling,
    "op10_pivot_near_dedup": pivots.op10_pivot_near_dedup,
}

SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": jaccard.OP2_SQL,
    "op3_curriculum_mix": curriculum.OP3_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op8_warc_round_trip": archives.OP8_SQL,
    "op10_pivot_near_dedup": pivots.OP10_SQL,
}
