"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP8_SQL, op8_decontaminate
from .html_extract import op5_html_extract
from .language_id import op4_language_id
from .license_scan import op1_license_scan
from .media_match import op2_media_match
from .ngram_join import OP10_SQL, op10_ngram_join
from .packing import op3_packing
from .token_counts import op6_token_counts
from .token_files import op7_token_files
from .toxicity import op9_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_media_match, op3_packing, op4_language_id, op5_html_extract, op6_token_counts, op7_token_files, op8_decontaminate, op9_toxicity, op10_ngram_join, pipeline)
}
ORACLE_SQL = {"op8_decontaminate": OP8_SQL, "op10_ngram_join": OP10_SQL}
