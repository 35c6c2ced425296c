"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.session import materialize

# Rows of one key that one task should join.
ROWS_PER_SALT = 500_000


def key_salts(df: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(keys, _salts) for every key with more than `rows_per_salt` rows: the tasks it is cut into.

    Counted with partial sums over the key columns alone, and written, so that its size is known to the planner.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_salt)
    return materialize(counts.select(*keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")), "key-salts")


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", residual: Column | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Equi-join on `keys` plus `residual`, `big` on the left, frequent keys of `big` spread over several tasks.

    Rows of a frequent key in `big` get a random-looking salt from their content and the matching rows of `small` are
    repeated once per salt; the number of salts follows the key's own count, and there is no limit to such keys. Column
    names must differ between the sides except `keys`. Every row of `big` meets each matching row of `small` exactly
    once, so inner, left, semi and anti all hold.
    """
    hot = key_salts(big, keys, rows_per_salt)
    row_hash = F.xxhash64(*[F.col(c) for c in big.columns])
    big = big.join(hot, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(row_hash, F.col("_salts")), F.lit(0))).drop("_salts")
    s = small.join(hot, keys, "left").withColumn(
        "_s_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    s = s.select(*[F.col(k).alias(f"_s_{k}") for k in keys], *[c for c in s.columns if c not in keys])
    conditions = [F.col(k) == F.col(f"_s_{k}") for k in keys] + [F.col("_salt") == F.col("_s_salt")]
    if residual is not None:
        conditions.append(residual)
    joined = big.join(s, reduce(lambda a, b: a & b, conditions), how)
    return joined.drop("_salt", "_s_salt", *[f"_s_{k}" for k in keys])
