"""Register sheets: any rows with a header, from CSV, JSON or Parquet exports, to register entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import verdicts as V
from tessera.sources import xlsx

# Header names of each field, over the years.
HEADERS = {
    "id": ["claim id", "id", "claim identifier", "register id"],
    "nutrient": ["nutrient, substance, food or food category", "nutrient", "substance"],
    "claim_en": ["claim", "claim text", "claim wording", "wording"],
    "claim_de": ["claim de", "claim (de)", "claim_de", "claim german"],
    "conditions": ["conditions of use of the claim", "conditions", "conditions of use"],
    "health_relationship": ["health relationship", "health benefit", "health relationship of the claim"],
    "status": ["status", "claim status", "outcome"],
    "claim_type": ["claim type", "type of claim", "article", "regulation article"],
    "regulation_reference": ["regulation", "commission regulation", "ec regulation", "eu regulation"],
    "entry_date": ["entry date", "date", "date of entry", "publication date"],
}


def _bare(name: str) -> str:
    return " ".join("".join(" " if c in ".,:()/" else c for c in name.strip().lower()).split())


def columns_of(headers: list) -> dict:
    """The header that stands for each field; the first that matches."""
    found = {}
    for field, names in HEADERS.items():
        wanted = {_bare(n) for n in names}
        match = next((h for h in headers if _bare(h or "") in wanted), None)
        if match is not None:
            found[field] = match
    return found


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's active sheet, or a CSV export, with a header line; quoted cells may span lines. A workbook without rows has no entries."""
    if path.lower().endswith(".xlsx"):
        return xlsx.read_table(spark, path, empty=HEADERS)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def entries(sheet: DataFrame) -> DataFrame:
    """Register entries. Rows without id and wording are dropped; a missing id is made from the wording."""
    found = columns_of(sheet.columns)
    if "id" not in found:
        raise ValueError("the sheet has no id column")
    raw = sheet.select(*[(X.none_if_empty(F.col(f"`{found[f]}`")) if f in found else F.lit(None).cast("string")).alias(f) for f in HEADERS])
    kept = raw.where("id is not null or claim_en is not null or claim_de is not null")
    made = F.concat(F.lit("gen-"), F.substring(F.sha2(F.concat_ws("|", F.coalesce("claim_en", F.lit("")), F.coalesce("claim_de", F.lit(""))), 256), 1, 16))
    return kept.withColumns({"id": F.coalesce("id", made), "status": V.register_status(F.col("status")), "claim_type": F.when(F.col("claim_type").isNull(), "unknown").otherwise(V.register_claim_type(F.col("claim_type"))), "entry_date": X.any_date(F.col("entry_date"))})


def annex_entries(rows: DataFrame) -> DataFrame:
    """Annex table rows (doc, page, n, cells array<string>) to entries; the sequence id counts kept rows of a document."""
    cell = lambda i: X.clean_cell(F.get("cells", F.lit(i)))
    body = rows.where((F.lower(F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))) != "angabe") & (F.length(cell(0)) > 10))
    number = F.row_number().over(W.partitionBy("doc").orderBy("page", "n"))
    return body.select("doc", F.format_string("vo432-%03d", number).alias("id"), X.nutrient_hint(cell(0)).alias("nutrient"), cell(0).alias("claim_de"), X.merged_conditions(cell(1), cell(2)).alias("conditions"), cell(3).alias("health_relationship"), F.lit("authorised").alias("status"), F.lit("art_13_1").alias("claim_type"))


def botanical_entries(rows: DataFrame) -> DataFrame:
    """EFSA rows (seq, key, food_text, original, revised) to entries: keys that begin with a digit, the first of each, gaps filled."""
    first = rows.where(F.col("key").rlike("^[0-9]")).withColumn("_k", F.row_number().over(W.partitionBy("key").orderBy("seq"))).where("_k = 1").drop("_k")
    parts = X.food_and_relationship(F.col("food_text"))
    wording = F.coalesce(X.none_if_empty(F.col("original")), X.none_if_empty(F.col("revised")))
    name = F.substring(X.slug(parts["food"]), 1, 40)
    return first.select("key", F.concat(F.lit("efsa-"), name, F.lit("-"), F.col("key")).alias("id"), parts["food"].alias("food"), X.none_if_empty(parts["relationship"]).alias("health_relationship"), F.substring(wording, 1, 200).alias("pending_claim"), F.substring(F.concat_ws(" ", parts["food"], parts["relationship"], wording), 1, 600).alias("summary"))


def botanical_sheet(spark: SparkSession, path: str, sheet: str = "Sheet1", first: int = 3) -> DataFrame:
    """Rows (seq, key, food_text, original, revised) of a workbook of pending claims: the first four columns from row first on."""
    cell = lambda i: F.get("cells", F.lit(i))
    rows = xlsx.read_rows(spark, path, sheet).where(F.col("row") >= first)
    return rows.select(F.col("row").alias("seq"), cell(0).alias("key"), cell(1).alias("food_text"), cell(2).alias("original"), cell(3).alias("revised"))


def most_frequent(found: DataFrame, column: str, first: int = 10) -> DataFrame:
    """The first values of a column by number of entries, ties by value; entries without one don't count."""
    return found.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(first)


def status_counts(found: DataFrame) -> DataFrame:
    """Entries by status and claim type."""
    return found.groupBy("status", "claim_type").agg(F.count("*").alias("n"))
