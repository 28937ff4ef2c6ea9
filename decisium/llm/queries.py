"""Queries of the training-data operators and the SQL that some can be held to."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .decontaminate import op7_decontamination
from .html_extract import op12_html_extraction
from .language_id import op8_language_id
from .line_dedup import op5_line_dedup
from .near_dup import op2_minhash_near_dup
from .oracles import OP2_SQL, OP4_SQL, OP5_SQL, OP7_SQL, OP9_SQL, OP10_SQL, OP12_SQL, OP13_SQL
from .packing import op6_best_fit_packing
from .phrase_dedup import op4_phrase_dedup
from .prefix_trie import op13_prefix_trie
from .suffix_dedup import op9_suffix_dedup
from .token_store import op1_token_store
from .url_filter import OP3_SQL, op3_url_filter
from .vector_links import op10_embedding_near_dup

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_minhash_near_dup,
        op3_url_filter,
        op4_phrase_dedup,
        op5_line_dedup,
        op6_best_fit_packing,
        op7_decontamination,
        op8_language_id,
        op9_suffix_dedup,
        op10_embedding_near_dup,
        op11_token_alignment,
        op12_html_extraction,
        op13_prefix_trie,
    )
}

ORACLES = {
    "op2_minhash_near_dup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op4_phrase_dedup": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_embedding_near_dup": OP10_SQL,
    "op12_html_extraction": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
