"""The registered queries of this subpackage and, where SQL can state them, the SQL that gives the same rows."""

from __future__ import annotations

from tapewright.llm.byte_bpe import op10_byte_bpe
from tapewright.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from tapewright.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from tapewright.llm.filter_audit import OP13_SQL, op13_filter_audit
from tapewright.llm.language_id import op9_language_id
from tapewright.llm.license_scan import OP4_SQL, op4_license_scan
from tapewright.llm.minhash_dedup import OP2_SQL, op2_minhash_dedup
from tapewright.llm.packing import op6_packing
from tapewright.llm.phrases import OP11_SQL, op11_phrase_mining
from tapewright.llm.substring_dedup import OP12_SQL, op12_substring_dedup
from tapewright.llm.token_counts import op1_token_counts
from tapewright.llm.toxicity import op7_toxicity
from tapewright.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op2_minhash_dedup": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op4_license_scan": OP4_SQL, "op5_url_filter": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op11_phrase_mining": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
