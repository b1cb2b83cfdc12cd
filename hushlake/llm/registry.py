"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from hushlake.llm import centroids, exact_dedup, filter_audit, html_text, jaccard, lm_score, mixing, near_vectors, packing, secrets, token_count, toxicity, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_token_count": token_count.op4_token_count,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_packing": packing.op6_packing,
    "op7_near_vectors": near_vectors.op7_near_vectors,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_html_extraction": html_text.op10_html_extraction,
    "op11_centroids": centroids.op11_centroids,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_secret_scan": secrets.op13_secret_scan,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_secret_scan": secrets.OP13_SQL,
}
