"""Prompt registry: markdown files with a front matter of `key: value` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("task", "version", "model", "author", "created_at", "description")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return parse_prompts(raw.withColumnRenamed("value", "raw"))


def parse_prompts(raw: DataFrame) -> DataFrame:
    """raw(path, raw) with the front matter's fields, body, and valid: all fields there, a numeric version."""
    front = F.regexp_extract("raw", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    df = raw.withColumn("front", front).withColumn("body", F.trim(F.regexp_replace("raw", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")))
    for f in FIELDS:
        value = F.btrim(F.regexp_extract("front", rf"(?m)^{f}:[ \t]*(.*?)[ \t\r]*$", 1), F.lit("\"'"))
        df = df.withColumn(f, F.when(value != "", value))
    ok = F.col("task").isNotNull() & F.coalesce(F.col("version").rlike(r"^\d+\.\d+\.\d+$"), F.lit(False)) & F.col("model").isNotNull()
    return df.withColumn("valid", ok).drop("front", "raw")


def version_key(version):
    """Numbers of a version, so that 1.10.0 is after 1.9.0."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))


def latest(prompts: DataFrame) -> DataFrame:
    order = W.partitionBy("task").orderBy(F.desc(version_key(F.col("version"))))
    return prompts.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def render(prompts: DataFrame, values: DataFrame) -> DataFrame:
    """prompts joined by task to values(task, vars map<string,string>); missing lists variables without a value."""
    df = prompts.join(values, "task").withColumn("names", F.array_distinct(F.regexp_extract_all("body", F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1))))
    df = df.withColumn("missing", F.filter("names", lambda n: ~F.map_contains_key(F.col("vars"), n)))
    fill = F.aggregate("names", F.col("body"), lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"\{\{\s*"), n, F.lit(r"\s*\}\}")), F.replace(F.replace(F.element_at("vars", n), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))))
    return df.withColumn("rendered", F.when(F.size("missing") == 0, fill)).drop("names")
