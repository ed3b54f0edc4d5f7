"""The operators' registered queries: (spark, sf_dir) -> DataFrame."""

from . import crosstok, ctw, decontaminate, imatch, jaccard, lattice, quality, ranked, simhash, suffix_array, tokens, toxicity, warc

QUERIES = {
    "op1_piece_lattice": lattice.query,
    "op2_positional_index": decontaminate.query,
    "op3_imatch": imatch.query,
    "op4_suffix_array": suffix_array.query,
    "op5_simhash_near_dedup": simhash.query,
    "op6_token_files": tokens.query,
    "op7_warc_store": warc.query,
    "op8_context_tree": ctw.query,
    "op9_toxicity": toxicity.query,
    "op10_quality": quality.query,
    "op11_token_alignment": crosstok.query,
    "op12_ngram_join": jaccard.query,
    "op13_shared_search": ranked.query,
}

#: DuckDB twins, where SQL can express the query.
ORACLE: dict[str, str] = {"op2_positional_index": decontaminate.ORACLE_SQL, "op13_shared_search": ranked.ORACLE_SQL}
