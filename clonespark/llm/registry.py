"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from clonespark.llm import exact_search, fill_middle, license_scan, mixing, substring_dedup, vector_codes, warc_zip
from clonespark.llm.ann import op10_ann_search
from clonespark.llm.bpe import op7_bpe_codec
from clonespark.llm.lm_scoring import op1_lm_scoring
from clonespark.llm.quality import op3_quality_classifier
from clonespark.llm.simhash import op9_simhash_near_dedup
from clonespark.llm.substring_dedup import op4_substring_dedup
from clonespark.llm.wordpiece import op8_token_counts

QUERIES: dict[str, Callable] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_warc_zip": warc_zip.op2_warc_zip,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_exact_topk": exact_search.op6_exact_topk,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_token_counts": op8_token_counts,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_ann_search": op10_ann_search,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_license_scan": license_scan.op13_license_scan,
}
ORACLES: dict[str, str] = {
    "op2_warc_zip": warc_zip.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op6_exact_topk": exact_search.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_fill_in_middle": fill_middle.ORACLE,
    "op13_license_scan": license_scan.ORACLE,
}
