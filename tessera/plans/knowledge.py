"""The knowledge table: payloads and embedding inputs of five sources, unions, first source wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X

SNIPPET = 600
COLUMNS = ("chunk_id", "source_type", "snippet", "reference", "url", "embedding_text", "metadata")
REGISTER_URL = "https://ec.europa.eu/food/food-feed-portal/screen/health-claims-register"
BOTANICAL_LABEL = {"on_hold": "EFSA on-hold", "non_authorised": "EFSA negativ bewertet", "authorised": "zugelassen"}


def _or_empty(*names: str) -> Column:
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names], F.lit(""))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" — ", *[F.when(p != "", F.trim(p)) for p in parts])


def _payload(df: DataFrame, chunk_id: str, source: str, snippet: Column, reference: Column, url: Column, text: Column, rest: list) -> DataFrame:
    meta = F.to_json(F.struct(*rest))
    return df.select(F.col(chunk_id).alias("chunk_id"), F.lit(source).alias("source_type"), F.substring(snippet, 1, SNIPPET).alias("snippet"), reference.alias("reference"), url.alias("url"), text.alias("embedding_text"), meta.alias("metadata"))


def register_chunks(df: DataFrame) -> DataFrame:
    claim = _or_empty("claim_de", "claim_en")
    base = F.coalesce(F.when(F.col("regulation_reference") != "", F.col("regulation_reference")), F.lit("EU-Register"))
    reference = F.when(F.col("nutrient") != "", F.concat(base, F.lit(" · "), "nutrient")).otherwise(base)
    return _payload(df, "id", "eu_claim", claim, reference, F.lit(REGISTER_URL), _joined(_or_empty("nutrient"), claim, _or_empty("conditions")), ["nutrient", "claim_de", "claim_en", "conditions", "status", "claim_type", "regulation_reference"])


def _article(df: DataFrame, regulation: Column, sign: str) -> Column:
    has = F.coalesce(F.col("paragraph").cast("string"), F.lit("")).isin("", "0")
    return F.concat(regulation, F.lit(sign), F.coalesce(F.col("article").cast("string"), F.lit("None")), F.when(has, "").otherwise(F.concat(F.lit(" Abs. "), F.col("paragraph").cast("string"))))


def regulation_chunks(df: DataFrame) -> DataFrame:
    """df: the chunker's columns, regulation_id and eur_lex_url."""
    reference = _article(df, F.concat(F.lit("VO "), "regulation_id"), ", Art. ")
    return _payload(df, "chunk_id", "regulation", _or_empty("text"), reference, _or_empty("eur_lex_url"), _joined(_or_empty("article_title"), _or_empty("text")), ["regulation_id", "article", "article_title", "paragraph", "section", "is_annex"])


def excerpt_chunks(df: DataFrame) -> DataFrame:
    reference = _article(df, F.col("regulation_id"), " § ")
    tags = F.array_join(F.coalesce("tags", F.array()), " ")
    return _payload(df, "chunk_id", "regulation", _or_empty("snippet"), reference, _or_empty("source_url"), _joined(_or_empty("title"), _or_empty("snippet"), tags), ["regulation_id", "article", "paragraph", "title", F.array_join("tags", ",").alias("tags")])


def case_chunks(df: DataFrame) -> DataFrame:
    reference = F.concat("court", F.lit(" "), "case_number", F.lit(" ("), "decision_date", F.lit(")"))
    tags = F.array_join(F.coalesce("tags", F.array()), " ")
    checked = F.coalesce(F.when(F.col("verification_status") != "", F.col("verification_status")), F.lit("verified"))
    rest = ["court", "case_number", "decision_date", "decision", "claim_type", "title", F.array_join("tags", ",").alias("tags"), F.array_join("legal_basis", ",").alias("legal_basis"), checked.alias("verification_status"), "ai_confidence"]
    return _payload(df, "id", "case_law", _or_empty("summary"), reference, X.case_url(F.col("case_number"), F.col("source_url")), _joined(_or_empty("title"), _or_empty("summary"), tags), rest)


def botanical_chunks(df: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for p in BOTANICAL_LABEL.items() for x in p])
    label = F.coalesce(F.element_at(labels, F.col("status")), F.col("status"), F.lit(""))
    reference = F.concat(F.lit("EFSA-Botanical · "), "common_name_de", F.lit(" ("), "scientific_name", F.lit(") · "), label)
    names = F.array_join(F.coalesce("common_names", F.array()), " ")
    text = _joined(_or_empty("scientific_name"), _or_empty("common_name_de"), names, _or_empty("health_relationship"), _or_empty("summary"))
    return _payload(df, "id", "botanical", _or_empty("summary"), reference, _or_empty("source_url"), text, ["scientific_name", "common_name_de", F.array_join("common_names", ",").alias("common_names"), "status", "health_relationship"])


def union(parts: list) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_source_wins(parts: list, key: str, order: str) -> DataFrame:
    """Union of parts in which each key is kept from the first part that has it, its first row by order; null and empty keys go."""
    rows = union([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]).where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    first = F.row_number().over(W.partitionBy(key).orderBy("_part", order))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k", "_part")


def write(table: DataFrame, path: str) -> None:
    """Replace only the partitions of the sources that the table has."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_type").parquet(path)


def write_entries(entries: DataFrame, path: str, run_at: str, counts: tuple = ()) -> DataFrame:
    """Entries as JSON, and a manifest beside them: their number, and that of each value of the columns counts.

    Raises ValueError if there are no entries.
    """
    n = entries.count()
    if not n:
        raise ValueError("no entries")
    entries.write.mode("overwrite").json(f"{path}/entries")
    spark = entries.sparkSession
    manifest = spark.createDataFrame([(run_at, "all", None, n)], "run_at string, what string, value string, n long")
    for c in counts:
        own = entries.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
        manifest = manifest.unionByName(own.select(F.lit(run_at).alias("run_at"), F.lit(c).alias("what"), "value", "n"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")
