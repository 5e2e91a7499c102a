"""Jobs by symbol of which one may fail: rows of results and rows of failures, from one pass.

A job that raises for one symbol gives one row with the reason, and the query goes on with the others.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a reason at most.
MOST = 500


def run_jobs(rows: DataFrame, job: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts", least: int = 0) -> DataFrame:
    """keys, the job's columns and `failure`, which is null in rows of results.

    job: from the rows of one key in order of time to rows of the schema. What it raises becomes the one row of its key, with
    the kind of the error and its words. Keys with fewer than `least` rows fail with `insufficient_data`; null keys are keys
    of their own.
    """
    struct = T.StructType.fromDDL(schema)
    names = struct.names
    if clash := {*names} & {*keys, "failure"}:
        raise ValueError(f"columns of the job are named like a key: {sorted(clash)}")
    kinds = [rows.schema[k] for k in keys]
    whole = T.StructType([*kinds, *[T.StructField(f.name, f.dataType) for f in struct.fields], T.StructField("failure", T.StringType())])

    def told(key: tuple, reason: str) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), **dict.fromkeys(names), "failure": reason[:MOST]}], columns=whole.names).astype(object)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return told(key, "insufficient_data")
        try:
            found = job(pdf.sort_values(order, kind="stable").reset_index(drop=True))
            out = pd.DataFrame({n: found[n] for n in names}).astype(object)
        except Exception as e:  # whatever a job raises is a failure of its key alone
            return told(key, f"{type(e).__name__}: {e}")
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        out["failure"] = None
        return out[whole.names]

    return rows.groupBy(*keys).applyInPandas(run, whole)


def results(done: DataFrame) -> DataFrame:
    return done.where(F.col("failure").isNull()).drop("failure")


def failures(done: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys and reason, in order."""
    return done.where(F.col("failure").isNotNull()).select(*keys, F.col("failure").alias("reason")).orderBy(*keys)
