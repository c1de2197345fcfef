"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, decontam, language, near_dedup, pii, secrets, substring, token_files, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        url_filter.op1_url_filter,
        language.op2_language,
        token_files.op3_token_files,
        substring.op4_substring_dedup,
        pii.op5_surrogates,
        near_dedup.op6_minhash,
        ann.op7_neighbours,
        decontam.op8_decontamination,
        secrets.op9_secrets,
        bpe.op10_bpe,
    )
}
ORACLE_SQL = {"op1_url_filter": url_filter.OP1_SQL, "op4_substring_dedup": substring.OP4_SQL, "op6_minhash": near_dedup.OP6_SQL, "op8_decontamination": decontam.OP8_SQL}
