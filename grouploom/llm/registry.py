"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, context_tree, exact_dedup, fm_index, mixing, near_dedup, prefix_tree, quality, repeats, token_counts, topk, whitening


def queries():
    return {
        "op1_mixing": mixing.op1,
        "op2_topk": topk.op2,
        "op3_token_counts": token_counts.op3,
        "op4_near_dedup": near_dedup.op4,
        "op5_chat": chat.op5,
        "op6_quality": quality.op6,
        "op7_bpe": bpe.op7,
        "op8_repeats": repeats.op8,
        "op9_lm_score": context_tree.op9,
        "op10_exact_dedup": exact_dedup.op10,
        "op11_prefix_tree": prefix_tree.op11,
        "op12_decontamination": fm_index.op12,
        "op13_whitening": whitening.op13,
        "embedding_covariances": whitening.covariances,
        "chat_quotes": chat.quoted_conversations,
        "lm_word_base": context_tree.word_base,
    }


def oracle_sql():
    return {
        "op2_topk": topk.OP2_SQL,
        "op4_near_dedup": near_dedup.OP4_SQL,
        "op8_repeats": repeats.OP8_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op11_prefix_tree": prefix_tree.OP11_SQL,
        "op12_decontamination": fm_index.OP12_SQL,
        "embedding_covariances": whitening.COVARIANCES_SQL,
        "lm_word_base": context_tree.WORD_BASE_SQL,
        "chat_quotes": chat.QUOTED_SQL,
    }
