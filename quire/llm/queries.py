"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, gif, language_id, packing, phrases, pii, prefix_trie, secret_ledger, sentencepiece_bpe, shards, simhash, sstable, token_counts

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_simhash": simhash.op3_simhash,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_sstables": sstable.op5_sstables,
    "op6_packing": packing.op6_packing,
    "op7_sentencepiece": sentencepiece_bpe.op7_sentencepiece,
    "op8_shards": shards.op8_shards,
    "op9_gif": gif.op9_gif,
    "op10_language_id": language_id.op10_language_id,
    "op11_collocations": phrases.op11_collocations,
    "op12_secret_ledger": secret_ledger.op12_secret_ledger,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {**exact_dedup.ORACLE_SQL, **phrases.ORACLE_SQL, **secret_ledger.ORACLE_SQL, **prefix_trie.ORACLE_SQL}
