"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from .bpe import op7_bpe
from .chat_format import OP12_SQL, op12_chat_format
from .decontaminate import OP6_SQL, op6_decontaminate
from .license_scan import op10_license_scan
from .media import op8_media
from .minhash_dedup import op5_minhash_dedup
from .periodic import OP11_SQL, op11_periodic_runs
from .pii import op9_pii
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op1_toxicity
from .url_filter import op3_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_bpe": op7_bpe,
    "op8_media": op8_media,
    "op9_pii": op9_pii,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_format": op12_chat_format,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {"op2_substring_dedup": OP2_SQL, "op6_decontaminate": OP6_SQL, "op11_periodic_runs": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_vector_codes": OP13_SQL}
