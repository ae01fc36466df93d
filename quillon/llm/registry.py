"""The corpus queries and their SQL by name."""

from __future__ import annotations

from quillon.llm import toolcalls
from quillon.llm.ann import op2_multi_index_hashing
from quillon.llm.bpe import op8_bpe_encode_decode
from quillon.llm.decontaminate import op7_benchmark_decontamination
from quillon.llm.htmltext import op9_html_extraction
from quillon.llm.langid import op6_language_id
from quillon.llm.neardup import op3_minhash_near_dedup
from quillon.llm.oracles import ORACLES  # noqa: F401
from quillon.llm.quality import op4_quality_classifier
from quillon.llm.ranked import op12_ranked_search
from quillon.llm.spelling import op11_spelling_variants
from quillon.llm.tokencount import op10_token_counts
from quillon.llm.urlfilter import op13_url_filters
from quillon.llm.warc import op5_warc_transactions

QUERIES = {
    f.__name__: f
    for f in (
        toolcalls.op1_tool_call_linking, op2_multi_index_hashing, op3_minhash_near_dedup, op4_quality_classifier, op5_warc_transactions, op6_language_id, op7_benchmark_decontamination,
        op8_bpe_encode_decode, op9_html_extraction, op10_token_counts, op11_spelling_variants, op12_ranked_search, op13_url_filters,
    )
}
