"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op5_nearest_neighbours
from .embdups import OP9_SQL, op9_embedding_dedup
from .html_text import op3_html_extraction
from .licenses import OP10_SQL, op10_licenses
from .langid import op11_language_id
from .lm import op2_lm_scoring
from .minhash import OP7_SQL, op7_minhash_dedup
from .mixing import OP1_SQL, op1_mixing
from .pieces import op8_sentencepiece
from .toxicity import op6_toxicity
from .turns import OP12_SQL, op12_conversation_repair
from .urls import op4_url_filter
from .variants import OP13_SQL, op13_spelling_variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_html_extraction": op3_html_extraction,
        "op4_url_filter": op4_url_filter,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_toxicity": op6_toxicity,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_licenses": op10_licenses,
        "op11_language_id": op11_language_id,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op7_minhash_dedup": OP7_SQL, "op9_embedding_dedup": OP9_SQL, "op10_licenses": OP10_SQL, "op12_conversation_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
