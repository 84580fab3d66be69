"""Equi-joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 64
SALTS = 64


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> list:
    """Keys with more than 1/HOT_SHARE of all rows: at most HOT_SHARE of them, so the list is bounded."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(total // HOT_SHARE, 1000)
    return [r[0] for r in counts.where((F.col(n) > F.lit(least)) & F.col(key).isNotNull()).select(key).limit(HOT_SHARE).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: list, how: str = "left") -> DataFrame:
    """``left`` join ``right`` on ``key`` (unique in ``right``), hot keys dealt over SALTS tasks.

    ``spread`` is an expression over ``left`` that differs between the rows of one key. Only the rows of
    hot keys are salted, and only their single right row is repeated.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")
