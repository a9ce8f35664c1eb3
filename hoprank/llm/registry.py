"""The queries of this subpackage and their DuckDB statements."""

from . import chat, classifier, decontaminate, minhash, mixing, quality, repair, repeats, secrets, tokens, urls, warc, whitening

QUERIES = {
    "op1_warc_zip_archive": warc.warc_query,
    "op2_debruijn_repeats": repeats.repeats_query,
    "op3_budgeted_windows": chat.chat_query,
    "op4_minhash_near_dedup": minhash.near_dup_query,
    "op5_orc_token_ids": tokens.token_query,
    "op6_host_reputation": urls.url_query,
    "op7_benchmark_leaks": decontaminate.leak_query,
    "op8_markov_secrets": secrets.secrets_query,
    "op9_low_discrepancy_mix": mixing.mix_query,
    "op10_line_frequency": quality.quality_query,
    "op11_rule_ensemble": classifier.classifier_query,
    "op12_bidiagonal_whitening": whitening.whitening_query,
    "op13_four_russians_repair": repair.repair_query,
}

#: Tokenizing, character models and alignment have no SQL form; tests hold them against brute force.
SQL = {
    "op1_warc_zip_archive": warc.SQL,
    "op2_debruijn_repeats": repeats.SQL,
    "op3_budgeted_windows": chat.SQL,
    "op4_minhash_near_dedup": minhash.SQL,
    "op6_host_reputation": urls.SQL,
    "op9_low_discrepancy_mix": mixing.SQL,
    "op10_line_frequency": quality.SQL,
}
