"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quirework.llm import compression_bands, filter_audit, language_ftrl, mixture_packing, packing_gga, phrase_bitmaps, secret_links, simhash_bktree, token_rollup, toxicity_nbsvm, url_trie, warc_index, wu_manber

QUERIES = {
    f.__name__: f
    for f in (
        toxicity_nbsvm.op1_toxicity_nbsvm,
        url_trie.op2_url_trie,
        warc_index.op3_warc_index,
        secret_links.op4_secret_links,
        language_ftrl.op5_language_ftrl,
        compression_bands.op6_compression_bands,
        simhash_bktree.op7_simhash_bktree,
        packing_gga.op8_packing_gga,
        wu_manber.op9_wu_manber,
        token_rollup.op10_token_rollup,
        mixture_packing.op11_mixture_packing,
        filter_audit.op12_filter_audit,
        phrase_bitmaps.op13_phrase_bitmaps,
    )
}

ORACLES = {"op2_url_trie": url_trie.ORACLE, "op9_wu_manber": wu_manber.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_phrase_bitmaps": phrase_bitmaps.ORACLE}
