"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from quadrat.llm import audit, chat, embeddings, lines, mixing, negatives, ngram_join, pages, pieces, quality, secrets, suffixes, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_pieces": pieces.op2_pieces,
    "op3_lines": lines.op3_lines,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat": chat.op5_chat,
    "op6_pages": pages.op6_pages,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_audit": audit.op11_audit,
    "op12_suffixes": suffixes.op12_suffixes,
    "op13_negatives": negatives.op13_negatives,
}
SQL = {"op1_secrets": secrets.OP1_SQL, "op5_chat": chat.OP5_SQL, "op7_embeddings": embeddings.OP7_SQL, "op9_quality": quality.OP9_SQL, "op10_mixing": mixing.OP10_SQL, "op11_audit": audit.OP11_SQL, "op13_negatives": negatives.OP13_SQL}
