"""Queries and oracle SQL of this subpackage."""

from . import chat_format, decontaminate, exact_dedup, langid, mixing, ngram_join, quality, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_language": langid.op2_language,
    "op3_quality": quality.op3_quality,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_mix": mixing.op5_mix,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
