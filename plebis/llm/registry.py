"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from plebis.llm import ann, bpe, html, jaccard, media, mixing, pii, quality, repair, secrets, toxicity, urls, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_ann": ann.op2_ann,
    "op3_secrets": secrets.op3_secrets,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_url_filter": urls.op5_url_filter,
    "op6_quality": quality.op6_quality,
    "op7_html_text": html.op7_html_text,
    "op8_bpe": bpe.op8_bpe,
    "op9_media": media.op9_media,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_repair": repair.op11_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_pii": pii.op13_pii,
}
ORACLE_SQL = {"op5_url_filter": urls.OP5_SQL}
