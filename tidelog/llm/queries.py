"""The corpus operators as queries over whole tables."""

from __future__ import annotations

from tidelog.llm import bpe, chat, exact_dedup, html_extract, licenses, packing, quality, simhash, token_output, url_filter

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_simhash_dedup": simhash.query,
    "op3_token_ids": token_output.query,
    "op4_best_fit_packing": packing.query,
    "op5_url_filter": url_filter.query,
    "op6_quality_rules": quality.query,
    "op7_chat_format": chat.query,
    "op8_byte_bpe": bpe.query,
    "op9_license_scan": licenses.query,
    "op10_exact_dedup": exact_dedup.query,
    "license_base_columns": licenses.base_query,
}
#: Those of which SQL can say all; the others are tested against brute force, round trips or the libraries themselves.
ORACLES = {"op5_url_filter": url_filter.SQL, "op7_chat_format": chat.SQL, "op10_exact_dedup": exact_dedup.SQL, "license_base_columns": licenses.SQL}
