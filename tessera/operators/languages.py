"""Language of a text from character trigrams: profiles counted in Spark, scores added up in the JVM.

A trigram is three characters of the lower-cased text of which the middle one is a letter and the others
are letters or a word's edge. Profiles hold, for the GRAMS most frequent trigrams of each language, how
likely each language is to write it: round(1000 ln((n + 1/2) / total)). A text's score for a language is
the sum over its trigrams, all of them, and its probability follows from the scores (equal priors).

Scoring explodes trigrams, joins them with the profiles, of which there are at most languages x GRAMS,
and adds up by row; a task sums its own rows before anything is shuffled, so a row of sums leaves it for
each text, however long. Texts without a trigram of any profile are unknown.

Defined cases: null and empty texts are unknown and pass no gate; texts of null language teach nothing;
of languages with equal scores the first by code counts. Rows are told apart by more than their keys, so
repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.tables import materialise

#: Trigrams of each language's profile, and the most languages.
GRAMS, MOST_LANGUAGES = 400, 100
GERMAN, GATE, UNKNOWN = "de", 0.6, "unknown"


def trigrams(text: Column) -> Column:
    """All trigrams of a text, repeats included."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " "), F.lit(" "))
    return F.regexp_extract_all(spaced, F.lit(r"(?=([\p{L} ]\p{L}[\p{L} ]))"), F.lit(1))


def profiles(texts: DataFrame, grams: int = GRAMS) -> DataFrame:
    """(gram, lang, weight) from texts(lang, text): each chosen trigram with its weight in every language."""
    counts = materialise(texts.where("lang is not null").select("lang", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    every = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["total"]).alias("total")) for r in totals]).cast("array<struct<lang:string,total:bigint>>")
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    chosen = counts.withColumn("_k", first).where(F.col("_k") <= grams).select("gram").distinct()
    rows = chosen.select("gram", F.explode(every).alias("_l")).select("gram", "_l.*").join(counts, ["lang", "gram"], "left")
    likely = (F.coalesce("n", F.lit(0)) + 0.5) / F.col("total")
    return rows.select("gram", "lang", F.round(1000 * F.ln(likely)).cast("long").alias("weight"))


def detect(docs: DataFrame, profile: DataFrame, keep: list) -> DataFrame:
    """The columns keep of docs(text, ...), language and confidence, its probability; unknown has confidence 0."""
    languages = [r["lang"] for r in profile.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, trigrams(F.col("text")).alias("_grams"))
    if not languages:
        return rows.select(*keep, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"))
    weights = profile.groupBy("gram").pivot("lang", languages).agg(F.first("weight"))
    weights = weights.select("gram", *[F.col(f"`{x}`").alias(f"_w{i}") for i, x in enumerate(languages)])
    found = rows.select("_row", *keep, F.explode_outer("_grams").alias("gram")).join(F.broadcast(weights), "gram", "left")
    sums = found.groupBy("_row", *keep).agg(*[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(languages))])
    scores = [F.col(f"_s{i}") for i in range(len(languages))]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    language = F.lit(UNKNOWN)
    for s, code in reversed(list(zip(scores, languages))):
        language = F.when(s == best, code).otherwise(language)
    among = sum((F.exp((s - best) / 1000) for s in scores), F.lit(0.0))
    return sums.select(*keep, language.alias("language"), F.coalesce(1 / among, F.lit(0.0)).alias("confidence"))


def is_german(language: Column, confidence: Column, least: float = GATE) -> Column:
    """The gate: German is the most likely language, and at least so likely."""
    return (language == GERMAN) & (confidence >= least)
