"""Sparse hashed vectors as rows (key, bucket, w), and cosines by joining on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text


def embed(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, bucket, w): unit vectors; texts without tokens have no rows."""
    f = rows.select(key, F.explode(text.features(label)).alias("x")).select(key, text.bucket(F.col("x.f")).alias("bucket"), F.col("x.w").alias("w"))
    summed = f.groupBy(key, "bucket").agg(F.sum("w").alias("w"))
    norms = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return summed.join(norms, key).select(key, "bucket", (F.col("w") / F.col("n")).alias("w"))


def cosines(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Cosine of every pair that shares a bucket. One side should be small (questions): the join fans out by bucket."""
    joined = a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), "bucket")
    return joined.groupBy(a_key, b_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
