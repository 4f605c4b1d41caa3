"""Curated JSON files with one array of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import exists


def read_entries(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The entries of field, one row each; a file that isn't there gives none."""
    kind = T._parse_datatype_string(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    whole = T.StructType([T.StructField(field, T.ArrayType(kind))])
    return spark.read.schema(whole).option("multiLine", True).json(path).select(F.explode(field).alias("e")).select("e.*")


CASE = "id string, court string, case_number string, decision_date string, title string, claim_type string, decision string, summary string, legal_basis array<string>, tags array<string>, source_url string, verification_status string, ai_confidence string"
EXCERPT = "chunk_id string, regulation_id string, article string, paragraph string, title string, snippet string, source_url string, tags array<string>"
