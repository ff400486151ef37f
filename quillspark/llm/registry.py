"""Queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from .decontamination import OP2_SQL, op2_decontamination
from .embedding_neardup import OP7_SQL, op7_embedding_neardup
from .html_extraction import op5_html_extraction
from .language_id import op1_language_id
from .lexical_search import OP13_SQL, op13_lexical_search
from .line_rules import op11_quality_rules, op11_sql
from .minhash_neardup import OP9_SQL, op9_minhash_neardup
from .mixing import op6_mixing, op6_sql
from .paragraph_dedup import op4_substring_dedup
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op3_quality
from .sharding import op10_sharding, op10_sql
from .suffix_dedup import OP8_SQL, op8_suffix_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_mixing": op6_mixing,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_minhash_neardup": op9_minhash_neardup,
    "op10_sharding": op10_sharding,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": OP2_SQL,
        "op6_mixing": op6_sql(),
        "op7_embedding_neardup": OP7_SQL,
        "op8_suffix_dedup": OP8_SQL,
        "op9_minhash_neardup": OP9_SQL,
        "op10_sharding": op10_sql(),
        "op11_quality_rules": op11_sql(),
        "op12_prefix_trie": OP12_SQL,
        "op13_lexical_search": OP13_SQL,
    }
