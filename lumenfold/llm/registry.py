"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lumenfold.llm import clustering, divergence, exact_dedup, line_dedup, mixing, warc
from lumenfold.llm.clustering import op12_exponion_clusters
from lumenfold.llm.divergence import op13_source_divergence
from lumenfold.llm.exact_dedup import op4_exact_dedup
from lumenfold.llm.language_id import op11_language_id
from lumenfold.llm.line_dedup import op3_line_dedup
from lumenfold.llm.mixing import op7_mix_sources
from lumenfold.llm.ngram_join import op9_ngram_jaccard
from lumenfold.llm.packing import op6_best_two_fit
from lumenfold.llm.quality import op8_importance_resampling
from lumenfold.llm.secrets import op5_secret_links
from lumenfold.llm.token_store import op1_token_codec
from lumenfold.llm.vector_dedup import op10_cap_filters
from lumenfold.llm.warc import op2_warc_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_codec, op2_warc_index, op3_line_dedup, op4_exact_dedup, op5_secret_links, op6_best_two_fit, op7_mix_sources, op8_importance_resampling, op9_ngram_jaccard, op10_cap_filters, op11_language_id, op12_exponion_clusters, op13_source_divergence)
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE = {
    "op2_warc_index": warc.ORACLE["op2"],
    "op3_line_dedup": line_dedup.ORACLE["op3"],
    "op4_exact_dedup": exact_dedup.ORACLE["op4"],
    "op7_mix_sources": mixing.ORACLE["op7"],
    "op12_exponion_clusters": clustering.ORACLE["op12"],
    "op13_source_divergence": divergence.ORACLE["op13"],
}
