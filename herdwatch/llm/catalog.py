"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from herdwatch.llm import decontamination, fingerprints, language, licenses, manifest, near_duplicates, ngram_model, pieces, private_data, quality, ranked, toxicity, warc
from herdwatch.llm.oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece_gumbel": pieces.op1_sentencepiece_gumbel,
        "op2_pii_bootstrapped": private_data.op2_pii_bootstrapped,
        "op3_license_diagonals": licenses.op3_license_diagonals,
        "op4_minmax_near_dedup": near_duplicates.op4_minmax_near_dedup,
        "op5_language_ftrl": language.op5_language_ftrl,
        "op6_toxicity_automata": toxicity.op6_toxicity_automata,
        "op7_closed_syncmers": fingerprints.op7_closed_syncmers,
        "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
        "op9_quality_resampling": quality.op9_quality_resampling,
        "op10_warc_revisits": warc.op10_warc_revisits,
        "op11_merkle_manifest": manifest.op11_merkle_manifest,
        "op12_ngram_trie_scores": ngram_model.op12_ngram_trie_scores,
        "op13_ranked_search": ranked.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
