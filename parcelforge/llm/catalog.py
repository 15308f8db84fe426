"""Queries of the training-data operators by name, and the same rows in SQL where SQL can say them."""

from __future__ import annotations

from parcelforge.llm import byte_bpe, decontaminate, embedding_dedup, exact_dedup, jaccard_join, lattice_lm, pii, prefix_trie, quality, secrets, sort_means, toxicity, warc

QUERIES = {
    "op1_quality_gam": quality.op1_quality_gam,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity_kernel": toxicity.op3_toxicity_kernel,
    "op4_lattice_lm": lattice_lm.op4_lattice_lm,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op7_pii_boosting": pii.op7_pii_boosting,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_warc": warc.op9_warc,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_sort_means": sort_means.op12_sort_means,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_jaccard_join": jaccard_join.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_sort_means": sort_means.OP12_SQL,
    "op13_exact_dedup": exact_dedup.OP13_SQL,
}
