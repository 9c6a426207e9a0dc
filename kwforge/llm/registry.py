"""Queries of the subpackage and the SQL that holds for them."""

from kwforge.llm import (
    best_fit_packing,
    byte_bpe,
    embedding_dedup,
    html_extract,
    minhash_dedup,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    token_counts,
    whitening,
    word_bpe,
)

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_best_fit_packing": best_fit_packing.op4_best_fit_packing,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_whitening": whitening.op11_whitening,
    "op12_word_bpe": word_bpe.op12_word_bpe,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {"op9_quality_rules": quality_rules.SQL, "op13_prefix_trie": prefix_trie.SQL}
