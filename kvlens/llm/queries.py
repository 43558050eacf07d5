"""The registered training-data queries and their SQL."""

from __future__ import annotations

from kvlens.llm import chat, fingerprint, jaccard, media, mixing, pieces, secrets, tokens, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op7_token_counts": tokens.op7_token_counts,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_chat": chat.op4_chat,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_media": media.op6_media,
    "op10_mixing": mixing.op10_mixing,
    "op8_secrets": secrets.op8_secrets,
    "op9_sentencepiece": pieces.op9_sentencepiece,
}

ORACLE_SQL = {"op1_warc": warc.OP1_SQL, "op3_ngram_jaccard": jaccard.OP3_SQL, "op4_chat": chat.OP4_SQL}
