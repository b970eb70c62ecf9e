"""The queries of this package and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP8_SQL, op8_decontaminate
from .jaccard_join import op6_jaccard_join
from .language_id import op9_language_id
from .media import op3_media
from .packing import op1_pack
from .quality import op7_quality
from .secrets import op5_secrets
from .toxicity import op4_toxicity
from .url_filter import OP10_SQL, op10_url_filter
from .warc_revisit import OP2_SQL, op2_warc_revisit


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pack, op2_warc_revisit, op3_media, op4_toxicity, op5_secrets, op6_jaccard_join, op7_quality, op8_decontaminate, op9_language_id, op10_url_filter]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisit": OP2_SQL, "op8_decontaminate": OP8_SQL, "op10_url_filter": OP10_SQL}
