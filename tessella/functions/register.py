"""The engine's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import entity
from . import tables, text, urls

#: SQL bodies of functions of one text, as Spark runs them natively.
BODIES = {
    "company_key": r"lower(trim(regexp_replace(coalesce(s, ''), '(?U)\\s+', ' ')))",
    "slugify": r"trim(BOTH '_' FROM regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]+', '_'))",
    "company_core": r"trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce(s, '')), '[.,&]', ' '), '\\s+', ' ')), '((^| )(" + "|".join(text.LEGAL_SUFFIXES) + r"))+$', ''))",
    "url_host": r"regexp_replace(regexp_replace(lower(element_at(split(regexp_extract(regexp_replace(trim(coalesce(s, '')), '^(?i)[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*', 0), '@'), -1)), ':.*$', ''), '^www\\.', '')",
    "is_job_board": r"url_host(s) RLIKE '(^|\\.)(" + "|".join(h.replace(".", r"\\.") for h in urls.BOARD_HOSTS) + r")$'",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Register them for spark.sql in this session; the names. A name's function is replaced."""
    for name, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {'BOOLEAN' if name.startswith('is_') else 'STRING'} RETURN {body}")
    spark.udf.register("text_similarity", entity.ratio)
    spark.udf.register("compat_form", text.compat_form)
    spark.udf.register("ascii_lower", text.ascii_lower)
    return [*BODIES, "text_similarity", "compat_form", "ascii_lower", *tables.register(spark)]
