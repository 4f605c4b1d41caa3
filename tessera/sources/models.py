"""Model calls as a source of rows: a batch callable inside mapInArrow, a deterministic stub by default.

call adds answers to requests as a plan, so whatever reads its result twice asks twice. Chains, which
branch on answers and ask again, go through Answers instead: a table that is written before anything
reads it, keyed by a digest of what was asked, the kind of call and the attempt.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import new_path, read_if_there

ATTEMPTS = 3
#: Seconds before a batch is tried again, doubled each time up to the second figure; seconds that a request may take.
WAIT_S, MOST_WAIT_S, LIMIT_S = 1.0, 9.0, 60.0
#: Requests of one call: so many of an Arrow batch are Python objects at once.
CALL_ROWS = 500
#: What each kind of call answers, for from_json.
SCHEMAS = {
    "detect": "claims array<struct<claim_text:string,claim_type:string,nutrient:string,substance:string,implicitness:string>>",
    "evaluate": "status string, risk string, confidence string, reasoning string, rewrite string, hints array<struct<chunk_id:string,reference:string,rationale:string>>",
    "rewrite": "rewrite string",
    "paragraph": "text string",
    "polish": "text string",
    "audit": "shippable boolean, assessment string, findings array<struct<severity:string,issue:string,quote:string,new:string>>",
    "apply": "text string, applied int",
}
#: Token counts that a model may report beside its answer, as `usage`.
USAGE = "usage struct<tokens_in:int,tokens_out:int,cache_read:int,cache_created:int>"
#: An answers table: the request's digest, the answer as it came, what went wrong, how often the batch was tried.
ANSWERS = "ask string, raw string, error string, attempts int, kind string, attempt int"


class BatchCaller(Protocol):
    """Takes a frame of requests, returns one JSON text (or None) for each."""

    def __call__(self, requests: pd.DataFrame) -> list: ...


def stub(requests: pd.DataFrame) -> list:
    """No findings at all, whatever is asked."""
    return ['{"claims": []}'] * len(requests)


def tried(caller: BatchCaller, requests: pd.DataFrame, wait_s: float = WAIT_S, limit_s: float = LIMIT_S) -> tuple[list, str | None, int]:
    """(answers, error, tries) of a batch: failures and overruns are tried again after a growing wait, ATTEMPTS times in all."""
    for tries in range(1, ATTEMPTS + 1):
        pool = ThreadPoolExecutor(1)
        try:
            answers = list(pool.submit(caller, requests).result(timeout=limit_s * len(requests)))
            if len(answers) != len(requests):
                raise ValueError(f"{len(answers)} answers to {len(requests)} requests")
            return answers, None, tries
        except Exception as e:  # noqa: BLE001 - whatever a model client raises is reported in the row
            error = type(e).__name__
        finally:
            pool.shutdown(wait=False)
        if tries < ATTEMPTS:
            time.sleep(min(MOST_WAIT_S, wait_s * 2 ** (tries - 1)))
    return [None] * len(requests), error, ATTEMPTS


def asked(requests: DataFrame, caller: BatchCaller, wait_s: float = WAIT_S, limit_s: float = LIMIT_S) -> DataFrame:
    """requests with raw, error and attempts, one call for up to CALL_ROWS of an Arrow batch."""
    kinds = [pa.string(), pa.string(), pa.int32()]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CALL_ROWS):
                part = batch.slice(start, CALL_ROWS)
                raw, error, tries = tried(caller, part.to_pandas(), wait_s, limit_s)
                told = [pa.array(x, k) for x, k in zip((raw, [error] * len(raw), [tries] * len(raw)), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *told], names=out.names)

    out = T.StructType([*requests.schema.fields, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    return requests.mapInArrow(run, out)


def parsed(answered: DataFrame, schema: str) -> DataFrame:
    """output by schema and usage in place of raw; an answer that can't be read is a bad_json, one without counts has null usage."""
    output = F.from_json("raw", schema, {"mode": "PERMISSIVE"})
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("raw").isNotNull() & output.isNull(), "bad_json")
    usage = F.from_json("raw", USAGE, {"mode": "PERMISSIVE"})["usage"]
    return answered.withColumns({"output": output, "error": bad, "usage": usage}).drop("raw")


def call(requests: DataFrame, caller: BatchCaller = stub, schema: str = SCHEMAS["detect"], wait_s: float = WAIT_S, limit_s: float = LIMIT_S) -> DataFrame:
    """requests with output (parsed by schema), error and attempts. A batch that fails is tried ATTEMPTS times, then marked."""
    return parsed(asked(requests, caller, wait_s, limit_s), schema)


def digest(kind: str, attempt: int, columns: list) -> Column:
    """What names a request: a SHA-256 of its values, the kind of call and the attempt."""
    values = F.struct(*[F.col(c) for c in columns], F.lit(kind).alias("__kind"), F.lit(attempt).alias("__attempt"))
    return F.sha2(F.to_json(values, {"ignoreNullFields": "false"}).cast("binary"), 256)


class Answers:
    """A table of model answers: each request is asked once, however often plans read the answer.

    ask() writes what isn't there yet and then joins the requests with the table. Equal requests share
    an answer. A path that is given again is gone on with: only what it lacks is asked. rounds splits a
    large set of requests by digest; a job that dies loses at most the round it was in. Within a round a
    task's answers count once it has ended, so a lost executor repeats only the batches it was working on.
    A failure is an answer too, with its error: chains ask a second attempt where they want one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rounds: int = 1, wait_s: float = WAIT_S, limit_s: float = LIMIT_S):
        self.spark, self.rounds, self.wait_s, self.limit_s = spark, rounds, wait_s, limit_s
        self.path = path or new_path(spark, "answers")

    def table(self) -> DataFrame:
        return read_if_there(self.spark, self.path, ANSWERS)

    def known(self, kind: str, attempt: int) -> DataFrame:
        return self.table().where((F.col("kind") == kind) & (F.col("attempt") == attempt)).drop("kind", "attempt")

    def ask(self, requests: DataFrame, caller: BatchCaller, kind: str, attempt: int = 1) -> DataFrame:
        """requests with output, error and attempts. The caller sees their columns and the attempt."""
        named = requests.withColumn("__ask", digest(kind, attempt, requests.columns))
        for i in range(self.rounds):
            part = named if self.rounds == 1 else named.where(F.pmod(F.xxhash64("__ask"), F.lit(self.rounds)) == i)
            lacking = part.dropDuplicates(["__ask"]).join(self.known(kind, attempt), F.col("__ask") == F.col("ask"), "left_anti")
            answered = asked(lacking.withColumn("attempt", F.lit(attempt)), caller, self.wait_s, self.limit_s)
            rows = answered.select(F.col("__ask").alias("ask"), "raw", "error", "attempts", F.lit(kind).alias("kind"), F.lit(attempt).alias("attempt"))
            rows.write.mode("append").partitionBy("kind", "attempt").parquet(self.path)
        return parsed(named.join(self.known(kind, attempt), F.col("__ask") == F.col("ask")).drop("__ask", "ask"), SCHEMAS[kind])
