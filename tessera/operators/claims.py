"""Claims: verbatim positions, hint verification, aggregate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import verdicts as V
from tessera.operators.retrieval import small

#: Whole words by which a claim is looked up, and characters for claims of one or two words.
LEAD, GRAM = 5, 8


def locate(claims: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Claims (key, claim_text, ...) whose trimmed text occurs in their document, with the first occurrence's start and end."""
    trimmed = claims.withColumn("claim_text", F.trim("claim_text")).where("claim_text <> ''")
    at = F.expr("instr(text, claim_text)")
    return trimmed.join(docs.select(key, "text"), key).withColumn("start", at - 1).where("start >= 0").withColumn("end", F.col("start") + F.length("claim_text")).drop("text")


SHORTEST, LONGEST = 50, 50_000


def size_code(text: Column) -> Column:
    """Whether a text's length fits: too short, too long, or ok."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n < SHORTEST, "input_too_short").when(n > LONGEST, "input_too_long").otherwise("ok")


def input_code(sized: Column, german: Column) -> Column:
    """What is wrong with an input of a size code, or ok: its length, else that it isn't German."""
    return F.when(sized != "ok", sized).when(~german, "not_german").otherwise("ok")


def candidates(claims: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """claims(claim_text, ...) for each document that may hold one, by equi-joins.

    Where a claim occurs word for word, all of its words but the first and the last are words of the
    document: claims of three words or more are joined on a run of their inner words, LEAD of them or as
    many as there are. Shorter ones are joined on their first characters, GRAM of them or as many as
    there are. A document's runs of only those kinds that claims have are made, and kept if a claim has them.
    """
    words = lambda c: F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != "")
    claims = claims.withColumn("claim_text", F.trim("claim_text")).where("claim_text <> ''").withColumn("_words", words(F.col("claim_text")))
    inner = F.least(F.size("_words") - 2, F.lit(LEAD))
    # what a claim is looked up by: so many words, or, below zero, so many characters
    claims = claims.withColumn("_by", F.when(inner > 0, inner).otherwise(-F.least(F.length("claim_text"), F.lit(GRAM))))
    lead = F.when(F.col("_by") > 0, F.concat_ws(" ", F.slice("_words", F.lit(2), F.greatest(F.col("_by"), F.lit(0))))).otherwise(F.substr("claim_text", F.lit(1), -F.col("_by")))
    leads = claims.withColumn("_lead", F.xxhash64("_by", lead)).drop("_words", "_by")

    def runs(by: int):
        if by < 0:
            return F.transform(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{-by}}}))"), F.lit(1)), lambda g: F.xxhash64(F.lit(by), g))
        every = F.transform(F.sequence(F.lit(1), F.size("_w") - by + 1), lambda i: F.xxhash64(F.lit(by), F.concat_ws(" ", F.slice("_w", i, by))))
        return F.when(F.size("_w") >= by, every).otherwise(F.array().cast("array<bigint>"))

    kinds = sorted(r["_by"] for r in claims.select("_by").distinct().collect())  # LEAD + GRAM of them at most
    made = F.concat(F.array().cast("array<bigint>"), *[runs(by) for by in kinds])
    found = docs.where("text is not null").select(key, "text", words(F.col("text")).alias("_w")).select(key, F.explode(F.array_distinct(made)).alias("_lead"))
    return found.join(small(leads), "_lead").drop("_lead")


def verified_hints(hints: DataFrame, evidence: DataFrame) -> DataFrame:
    """hints(claim_id, chunk_id, ...) with verified, url, and chunk_id null unless the claim's own evidence has it.

    Hints without a reference or a rationale are dropped.
    """
    known = evidence.select("claim_id", "chunk_id", "url").dropDuplicates(["claim_id", "chunk_id"]).withColumn("_hit", F.lit(True))
    full = hints.where("reference is not null and rationale is not null")
    joined = full.join(known, ["claim_id", "chunk_id"], "left").withColumn("verified", F.col("_hit").isNotNull())
    return joined.withColumn("chunk_id", F.when(F.col("verified"), F.col("chunk_id"))).drop("_hit")


def hint_lists(told: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(claim_id, hints) of told(claim_id, hints): checked by verified_hints, in the order they came; claims without any are absent."""
    rows = told.select("claim_id", F.posexplode("hints").alias("place", "h")).select("claim_id", "place", "h.*")
    if evidence is None:
        evidence = rows.select("claim_id", "chunk_id", F.lit(None).cast("string").alias("url")).limit(0)
    one = F.struct("place", "reference", "rationale", "verified", "chunk_id", "url")
    # a model's hints on one claim
    lists = verified_hints(rows, evidence.select("claim_id", F.col("chunk_id").cast("string"), "url")).groupBy("claim_id").agg(F.array_sort(F.collect_list(one)).alias("hints"))
    return lists.withColumn("hints", F.transform("hints", lambda h: h.dropFields("place")))


def detected(model_spans: DataFrame, lexicon_spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Model spans, and the lexicon's that no model span covers, with origin."""
    from tessera.operators.lexicon import uncovered

    extra = uncovered(lexicon_spans, model_spans, key).withColumn("origin", F.lit("lexicon"))
    return model_spans.withColumn("origin", F.lit("model")).unionByName(extra, allowMissingColumns=True)


def evaluate(claims: DataFrame) -> DataFrame:
    """Raw verdicts (status, risk, confidence, reasoning, rewrite; all strings) of claims, coerced; disease claims take the shortcut."""
    cut = V.disease_shortcut(F.col("claim_type"), F.col("claim_text"))
    df = claims.withColumn("_cut", cut)
    pick = lambda name, own: F.coalesce(F.col(f"_cut.{name}"), own)
    df = df.withColumns({"confidence": pick("confidence", V.confidence(F.col("confidence"))), "risk": pick("risk", V.risk(F.col("risk"))), "status": pick("status", V.status(F.col("status"))), "reasoning": V.reasoning(F.col("reasoning"))})
    df = df.withColumn("_after", V.after_low_confidence(F.col("status"), F.col("confidence"), F.col("rewrite")))
    return df.withColumns({"status": F.col("_after.status"), "rewrite": F.when(F.col("_cut").isNull(), F.col("_after.rewrite"))}).drop("_after", "_cut")


def report(claims: DataFrame, key: str) -> DataFrame:
    """For each key: status counts, mean risk, compliance score."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = claims.groupBy(key).agg(n("allowed"), n("borderline"), n("forbidden"), n("unclear"), F.count("*").alias("total"), F.avg(V.risk_weight(F.col("risk"))).alias("risk_score"))
    score = V.compliance_score(F.col("forbidden"), F.col("borderline"), F.col("unclear"))
    return out.withColumn("compliance", score).withColumn("band", V.score_band(score))


def shippable(findings: DataFrame, key: str) -> DataFrame:
    """Blocking findings make a text unshippable; a model's flag may only lower that."""
    blocking = F.bool_or(F.lower("severity").isin("critical", "high"))
    return findings.groupBy(key).agg(F.coalesce(blocking, F.lit(False)).alias("blocking"), F.bool_and(F.coalesce("model_flag", F.lit(True))).alias("flag")).withColumn("shippable", ~F.col("blocking") & F.col("flag"))


def valid_findings(findings: DataFrame, severities: tuple = ("critical", "high", "medium", "low")) -> DataFrame:
    """Findings with a known severity and a text, in order of severity and then of place."""
    ok = F.lower("severity").isin(*severities) & (F.coalesce(F.trim("issue"), F.lit("")) != "")
    return findings.where(ok).withColumn("severity_rank", V.severity_rank(F.col("severity")))


def by_severity(findings: DataFrame, key: list, order: str) -> DataFrame:
    """valid_findings with their place within key: by severity, then by order."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy("severity_rank", order))
    return valid_findings(findings).withColumn("place", rank)


def precision_recall(predicted_and_gold: DataFrame, by: list) -> DataFrame:
    """Precision, recall and F1 of boolean columns predicted and gold."""
    p, g = F.col("predicted"), F.col("gold")
    out = predicted_and_gold.groupBy(*by).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def against_previous(scores: DataFrame, by: list, version: str) -> DataFrame:
    """precision_recall's scores with the change of F1 since the version before, null for the first."""
    before = F.lag("f1").over(W.partitionBy(*by).orderBy(version))
    return scores.withColumn("f1_change", F.col("f1") - before)


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int = 8) -> DataFrame:
    """Share of queries with a relevant chunk among the first k."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("_hit", F.lit(1))
    return relevant.select("query_id").distinct().join(hits, "query_id", "left").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def failures(evaluations: DataFrame, by: list, failed: Column) -> DataFrame:
    """For each group whether any evaluation failed, and how many."""
    return evaluations.groupBy(*by).agg(F.coalesce(F.bool_or(failed), F.lit(False)).alias("partial"), F.count_if(failed).alias("failed"))


def verification_counts(entries: DataFrame, status: str = "verification_status", default: str = "verified") -> DataFrame:
    """Entries by verification status; the default where none is given."""
    given = F.when(F.trim(status) != "", F.trim(status))
    return entries.groupBy(F.coalesce(given, F.lit(default)).alias("status")).agg(F.count("*").alias("n"))


def problems(claims: DataFrame) -> DataFrame:
    return claims.where(~F.col("status").eqNullSafe(F.lit("allowed")))


def applicable(claims: DataFrame) -> DataFrame:
    """Claims whose rewrite can be applied: there is one, and the verdict asks for it."""
    return claims.where(F.col("status").isin("borderline", "forbidden") & (F.coalesce(F.trim("rewrite"), F.lit("")) != ""))


def in_order(claims: DataFrame, key: str, start: str, then: str) -> DataFrame:
    """claims with their place in their text."""
    return claims.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(start, then)))


def with_validity(claims: DataFrame) -> DataFrame:
    """claims with is_valid: a known verdict and a confidence between 0 and 1; null is invalid."""
    known = F.lower(F.trim("status")).isin("allowed", "borderline", "forbidden", "unclear") & F.col("confidence").between(0, 1)
    return claims.withColumn("is_valid", F.coalesce(known, F.lit(False)))
