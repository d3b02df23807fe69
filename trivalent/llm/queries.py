"""The registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op3_nearest_neighbours
from .chat import OP12_SQL, op12_chat_format
from .decontamination import OP5_SQL, op5_decontamination
from .html_text import op10_html_extraction
from .merkle import OP11_SQL, op11_merkle_manifest
from .pii import op2_pii
from .quality import op6_quality_classifier
from .sentencepiece_bpe import op9_sentencepiece
from .simhash import op1_simhash_near_dedup
from .substring_dedup import op7_substring_dedup
from .url_filter import op8_url_filter
from .warc import OP4_SQL, op4_warc
from .whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_pii,
        op3_nearest_neighbours,
        op4_warc,
        op5_decontamination,
        op6_quality_classifier,
        op7_substring_dedup,
        op8_url_filter,
        op9_sentencepiece,
        op10_html_extraction,
        op11_merkle_manifest,
        op12_chat_format,
        op13_embedding_whitening,
    )
}

ORACLE_SQL = {"op4_warc": OP4_SQL, "op5_decontamination": OP5_SQL, "op11_merkle_manifest": OP11_SQL, "op12_chat_format": OP12_SQL}
