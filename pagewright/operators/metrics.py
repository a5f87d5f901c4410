"""Recognition accuracy: character and word error rates and their summary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import edit_distance, word_distance


def cer(prediction: Column, truth: Column) -> Column:
    """Character error rate; without truth 0 for an empty prediction and else 1.  Null reads as empty."""
    p, t = F.coalesce(prediction, F.lit("")), F.coalesce(truth, F.lit(""))
    empty = F.when(p == "", 0.0).otherwise(1.0)
    return F.when(t == "", empty).otherwise(edit_distance(p, t) / F.length(t))


@F.pandas_udf(T.DoubleType())
def wer(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    """Word error rate on white-space tokens; a rough signal where scripts do not separate words by spaces."""

    def rate(p: str | None, t: str | None) -> float:
        said, meant = (p or "").split(), (t or "").split()
        return word_distance(said, meant) / len(meant) if meant else float(bool(said))

    return pd.Series([rate(p, t) for p, t in zip(prediction, truth)], dtype="float64")


def compare(samples: DataFrame) -> DataFrame:
    """``samples`` (``prediction, truth``) with ``cer`` and ``wer``."""
    return samples.withColumn("cer", cer(F.col("prediction"), F.col("truth"))).withColumn(
        "wer", wer(F.col("prediction"), F.col("truth"))
    )


def summary(compared: DataFrame) -> DataFrame:
    """Number of samples and mean rates by language and model."""
    return (
        compared.groupBy("language", "model")
        .agg(F.count(F.lit(1)).cast("int").alias("n_samples"), F.avg("cer").alias("avg_cer"), F.avg("wer").alias("avg_wer"))
        .orderBy("language", "model")
    )
