"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most this many keys are treated as hot, so the broadcast list is bounded.
# Any key outside the list holds at most 1/HOT_KEYS of all rows.
HOT_KEYS = 1000
SALTS = 64


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, row_id: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Join ``facts`` (one row per ``key``) to ``rows`` (many per key).

    ``weight`` is a column of ``facts`` that says how many rows the key has;
    ``weights`` is a cheaper table with the same two columns, if there is one.
    Rows of the heaviest keys are spread over ``SALTS`` partitions by a hash of
    ``row_id``; only those keys' facts are copied. The hash makes a retried
    task produce the same placement.
    """
    hot = (weights if weights is not None else facts).orderBy(F.desc(weight), key).limit(HOT_KEYS).select(key, F.lit(1).alias("_hot"))
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*row_id), F.lit(SALTS)).cast("int")
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot") == 1, salt).otherwise(F.lit(0)))
    copies = F.when(F.col("_hot") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = facts.join(hot, key, "left").withColumn("_salt", F.explode(copies))
    right = right.drop("_hot", weight).withColumnRenamed(key, "_key").withColumnRenamed("_salt", "_other")
    # A null key is a key of its own.
    same = left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_other"])
    return left.join(right, same).drop("_hot", "_salt", "_key", "_other")
