"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, filter_audit, html_text, language_id, lexical, line_dedup, metric_tree, mixing, quality, secrets, set_join, token_counts, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language_id": language_id.op2_language_id,
    "op3_mixing": mixing.op3_mixing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_metric_tree": metric_tree.op5_metric_tree,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_set_join": set_join.op8_set_join,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_html_text": html_text.op10_html_text,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_secret_scan": secrets.op13_secret_scan,
}

ORACLE_SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_metric_tree": metric_tree.OP5_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op8_set_join": set_join.OP8_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_secret_scan": secrets.OP13_SQL,
}
