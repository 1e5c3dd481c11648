"""Registered queries of the corpus operators, and SQL twins where SQL can express them."""

from lociflow.llm.decontam import OP2_SQL, op2_decontamination
from lociflow.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from lociflow.llm.fill_middle import OP11_SQL, op11_fill_middle
from lociflow.llm.language import op8_language_id
from lociflow.llm.licenses import OP9_SQL, op9_license_scan
from lociflow.llm.mixing import OP5_SQL, op5_mixing
from lociflow.llm.ngram_join import OP3_SQL, op3_ngram_jaccard
from lociflow.llm.quality import op7_quality
from lociflow.llm.ranked_search import OP12_SQL, op12_ranked_search
from lociflow.llm.substring import op10_substring_dedup
from lociflow.llm.token_counts import op13_token_counts
from lociflow.llm.token_store import op4_token_ids
from lociflow.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_token_ids": op4_token_ids,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_counts": op13_token_counts,
}
ORACLES = {"op3_ngram_jaccard": OP3_SQL, "op2_decontamination": OP2_SQL, "op5_mixing": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op9_license_scan": OP9_SQL, "op11_fill_middle": OP11_SQL, "op12_ranked_search": OP12_SQL}
