"""The registered queries of this package: thin calls of the operators over whole tables."""

from __future__ import annotations

from fathomline.llm import attribution, bpe, fingerprint, language, neighbours, oracles, packing, pieces, prefix_trie, quotes, simhash, suffix_dedup, vector_codes, warc
from fathomline.llm.common import table


def op1_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_fingerprint(spark, sf_dir):
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return attribution.section_tokens(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_quotes(spark, sf_dir):
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op10_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_packing": op2_packing,
    "op3_fingerprint": op3_fingerprint,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_neighbours": op7_neighbours,
    "op8_quotes": op8_quotes,
    "op9_language": op9_language,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_bpe": op13_bpe,
}
#: The others need hashes, tokenizers or models that SQL lacks; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_warc": oracles.WARC,
    "op11_prefix_trie": oracles.PREFIX_TRIE,
    "op12_vector_codes": oracles.vector_codes(),
}
