"""The judge: a vectorised function over request tables, or recorded answers joined on the request's keys.

A request is a row: its keys, the columns of its state, and ``questions``, an array of at most QUESTIONS structs with a
``key``. The judge adds ``answers``, an array with the same keys, and the request's model and token counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Judge = Callable[[pd.DataFrame], pd.DataFrame]

QUESTIONS = 50  # fixed value: of one request
CALL_ROWS = 256  # requests that a judge function gets at a time
USAGE = "model string, input_tokens long, output_tokens long"
NOUL = f"answers array<struct<key:string,prob:double>>, {USAGE}"
SCORE = f"answers array<struct<key:string,score:double,confidence:double>>, {USAGE}"
CHOICE = f"choice string, confidence double, probabilities map<string,double>, {USAGE}"


def chunked(requests: DataFrame, size: int = QUESTIONS) -> DataFrame:
    """The same requests with ``chunk``, one row for each ``size`` questions, in their order; those without any go."""
    parts = F.ceil(F.size("questions") / size).cast("int")
    rows = requests.where(F.size("questions") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("questions", F.slice("questions", F.col("chunk") * size + 1, F.lit(size)))


def judge(requests: DataFrame, fn: Judge, answer: str, partitions: int | None = None) -> DataFrame:
    """requests with the columns that ``fn`` adds, of the schema ``answer``. The calls are spread over tasks by request, not by document."""
    spread = requests.repartition(partitions) if partitions else requests

    kinds = list(to_arrow_schema(StructType.fromDDL(answer)))

    def column(values: pd.Series, kind: pa.DataType) -> pa.Array:
        if pa.types.is_map(kind):
            values = values.map(lambda v: list(v.items()) if isinstance(v, dict) else v)
        return pa.Array.from_pandas(values, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # states stay in Arrow; only the requests of one call are Python objects
        for batch in batches:
            for part in (batch.slice(k, CALL_ROWS) for k in range(0, batch.num_rows, CALL_ROWS)):
                found = fn(part.to_pandas()).reset_index(drop=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *(column(found[f.name], f.type) for f in kinds)], names=[*part.schema.names, *(f.name for f in kinds)])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return spread.mapInArrow(run, f"{own}, {answer}")


def judge_noul(requests: DataFrame, fn: Judge, partitions: int | None = None) -> DataFrame:
    """A probability for each question."""
    return judge(requests, fn, NOUL, partitions)


def judge_score(requests: DataFrame, fn: Judge, partitions: int | None = None) -> DataFrame:
    """A score of 0 .. levels - 1 and a confidence for each question."""
    return judge(requests, fn, SCORE, partitions)


def judge_choice(requests: DataFrame, fn: Judge, partitions: int | None = None) -> DataFrame:
    """One choice of the request's ``options``, its confidence and the probability of each."""
    return judge(requests, fn, CHOICE, partitions)


def replay(requests: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded answers in place of a judge."""
    return requests.join(answers, keys)


def with_probability(questions: Column, answers: Column) -> Column:
    """An array of (q, prob), a question and its answer. Answers are taken by place where the keys agree there, else looked
    for; a question that lacks one is an error."""

    def one(q: Column, k: Column) -> Column:
        here = F.get(answers, k)
        found = F.get(F.filter(answers, lambda a: a["key"] == q["key"]), F.lit(0))["prob"]
        missing = F.raise_error(F.concat(F.lit("no answer to question "), q["key"])).cast("double")
        prob = F.when(here["key"] == q["key"], here["prob"]).otherwise(F.coalesce(found, missing))
        return F.struct(q.alias("q"), prob.alias("prob"))

    return F.transform(questions, one)


def record_calls(answered: DataFrame, request: list[str]) -> DataFrame:
    """One row a request. Where rows repeat the usage of their request it is taken once; a request has one model."""
    model = F.when(F.min("model").eqNullSafe(F.max("model")), F.min("model")).otherwise(F.raise_error(F.lit("a request has several models")))
    return answered.groupBy(*request).agg(model.alias("model"), F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"))
