"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, mixing, ngram_join, quality, secrets, token_blocks, toxicity, url_vocab, warc

QUERIES = {
    "op1_quality_rules": quality.op1_query,
    "op2_mix_sources": mixing.op2_query,
    "op3_html_extract": html_extract.op3_query,
    "op4_decontaminate": decontaminate.op4_query,
    "op5_warc_revisits": warc.op5_query,
    "op6_ngram_join": ngram_join.op6_query,
    "op7_token_blocks": token_blocks.op7_query,
    "op8_url_filter": url_vocab.op8_query,
    "op9_secret_scan": secrets.op9_query,
    "op10_toxicity": toxicity.op10_query,
}

# 1 and 10 are learned, 3 parses html, 4 aligns templates, 7 reads binary files
ORACLE_SQL = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op5_warc_revisits": warc.OP5_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op8_url_filter": url_vocab.OP8_SQL,
    "op9_secret_scan": secrets.OP9_SQL,
}
