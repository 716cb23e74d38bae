"""Sums of arrays over very many partial rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

FAN_IN = 100  # tasks whose arrays one step of the tree adds up
LEVELS = 2  # steps before the last one, which adds up whatever is left of a key: a 10,000th of the tasks


def merge_arrays(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per key with the elementwise sum of ``column``, of which every task has made one row per key at most.

    Arrays are added up in a tree of the tasks that made them and never exploded.  The tree's height is fixed, so nothing runs to
    find out how many tasks there are; its last step groups by the keys alone, so a key has one row however the tasks were dealt.
    """
    keys = list(keys)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_task", T.IntegerType()), df.schema[column]])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = {k: [None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**first, "_task": [int(pdf["_task"].iloc[0])], column: [np.sum(np.stack(pdf[column].to_numpy()), axis=0)]})

    out = df.withColumn("_task", F.spark_partition_id())
    for _ in range(LEVELS):
        out = out.withColumn("_task", (F.col("_task") / FAN_IN).cast("int")).groupBy(*keys, "_task").applyInPandas(lambda pdf: add(pdf), schema)
    return out.groupBy(*keys).applyInPandas(lambda pdf: add(pdf), schema).drop("_task")
