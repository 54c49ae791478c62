"""The judge's calls over large batches."""

import pandas as pd
from pyspark.sql import functions as F

from versoscan.operators import judge as J


def test_a_call_gets_few_requests(spark):
    """However large a batch is, a call and its Python objects hold at most CALL_ROWS requests; answers stay with their rows."""

    def fn(frame):
        n = len(frame)
        return pd.DataFrame({"answers": [[{"key": q["key"], "prob": i / 4096} for q in asked] for i, asked in zip(frame["id"], frame["questions"], strict=True)], "model": "m", "input_tokens": n, "output_tokens": 1})

    asked = spark.range(2000, numPartitions=1).withColumn("questions", F.array(F.struct(F.lit("a").alias("key"))))
    rows = J.judge_noul(asked, fn).select("id", "input_tokens", "answers").collect()
    assert len(rows) == 2000 and max(r.input_tokens for r in rows) == J.CALL_ROWS
    assert all(r.answers[0].key == "a" and r.answers[0].prob == r.id / 4096 for r in rows)
