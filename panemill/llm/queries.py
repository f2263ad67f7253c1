"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panemill.llm import audit, blocks, decon, langid, lengths, licenses, lm, mix, neardup, pii, search, stream, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_poisson_mix": mix.op1_poisson_mix,
    "op2_url_filter": urls.op2_url_filter,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_context_mixing": lm.op4_context_mixing,
    "op5_transport_stream": stream.op5_transport_stream,
    "op6_length_histogram": lengths.op6_length_histogram,
    "op7_decontamination": decon.op7_decontamination,
    "op8_token_files": blocks.op8_token_files,
    "op9_personal_data": pii.op9_personal_data,
    "op10_language_spans": langid.op10_language_spans,
    "op11_ranked_search": search.op11_ranked_search,
    "op12_filter_interactions": audit.op12_filter_interactions,
    "op13_license_scan": licenses.op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_poisson_mix": mix.SQL,
    "op2_url_filter": urls.SQL,
    "op3_near_duplicates": neardup.SQL,
    "op7_decontamination": decon.SQL,
    "op11_ranked_search": search.SQL,
    "op12_filter_interactions": audit.SQL,
    "op13_license_scan": licenses.SQL,
}
