"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm.bloom_lm import op8_bloom_lm
from folio.llm.fingerprints import op2_multiset_fingerprint
from folio.llm.idstore import op6_content_store
from folio.llm.langid import op5_language_id
from folio.llm.mixing import mix_sql, op3_mix_sources
from folio.llm.near_dedup import op9_bag_minhash
from folio.llm.packing import op10_pack_documents
from folio.llm.quality import op4_robust_outliers
from folio.llm.secrets import op1_secret_scan
from folio.llm.url_filter import op7_link_graph


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_multiset_fingerprint": op2_multiset_fingerprint,
        "op3_mix_sources": op3_mix_sources,
        "op4_robust_outliers": op4_robust_outliers,
        "op5_language_id": op5_language_id,
        "op6_content_store": op6_content_store,
        "op7_link_graph": op7_link_graph,
        "op8_bloom_lm": op8_bloom_lm,
        "op9_bag_minhash": op9_bag_minhash,
        "op10_pack_documents": op10_pack_documents,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": mix_sql(),
    }
