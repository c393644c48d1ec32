"""The corpus operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from newslens.llm.chat import op8_chat_format
from newslens.llm.collocations import OP13_SQL, op13_collocations
from newslens.llm.decontam import op10_decontamination
from newslens.llm.fingerprint import op3_fingerprints
from newslens.llm.language import op2_language_id
from newslens.llm.packing import op6_best_fit_packing
from newslens.llm.quality import op5_quality
from newslens.llm.secrets import op9_secret_scan
from newslens.llm.simhash import op1_simhash
from newslens.llm.topk import OP12_SQL, op12_topk
from newslens.llm.toxicity import op7_toxicity
from newslens.llm.url_filter import op4_url_filter
from newslens.llm.variants import OP11_SQL, op11_variants


_QUERIES = (op1_simhash, op2_language_id, op3_fingerprints, op4_url_filter, op5_quality, op6_best_fit_packing, op7_toxicity,
            op8_chat_format, op9_secret_scan, op10_decontamination, op11_variants, op12_topk, op13_collocations)
_SQL = {"op11_variants": OP11_SQL, "op12_topk": OP12_SQL, "op13_collocations": OP13_SQL}


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_queries() -> dict[str, str]:
    return _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
