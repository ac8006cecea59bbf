"""Group-safe train/validation/test splits (SPL-1..3, JON-9, AGG-11, FLT-2, SNK-2).

A split is a pure function of the group key: ``md5(seed:group)`` mapped to
[0, 1). Whole groups land on one side, the assignment is stable under
repartitioning and retries, and no shuffle is needed to assign it. (The
shuffle-based group sampler of the reference is not reproducible across
engines; the hash split keeps the expected ratio of *groups*, and
``two_way_split_exact`` the exact number.)
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.operators.ranks import numbered

_TWO_32 = 4294967296.0


def hash_fraction(group: Column | str, seed: int = 42) -> Column:
    g = F.col(group) if isinstance(group, str) else group
    h = F.md5(F.concat(F.lit(f"{seed}:"), g.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(_TWO_32)


def two_way_split(df: DataFrame, group_col: str, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """SPL-1: (train, test); whole groups go to one side; ratio 0 -> everything in train."""
    if ratio == 0:
        return df, df.limit(0)
    f = hash_fraction(group_col, seed)
    return df.where(f >= ratio), df.where(f < ratio)


def exact_threshold(df: DataFrame, group_col: str, ratio: float, seed: int = 42):
    """The last group of the test side in the order of (hash, group), or None: ``ceil(ratio * groups)`` groups lie up to it.
    Groups are numbered over ranges of that order; the driver gets this one row."""
    g = F.col(group_col)
    groups = df.select(hash_fraction(F.coalesce(g.cast("string"), F.lit("")), seed).alias("h"), g.isNull().alias("none"), g.cast("string").alias("g")).distinct()
    ranked = numbered(groups, [F.col("h"), F.col("none"), F.col("g")], "no")
    last = math.ceil(round(ratio * ranked.count(), 9))
    return ranked.where(F.col("no") == last).first()


def two_way_split_exact(df: DataFrame, group_col: str, ratio: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """SPL-1 with exact counts: (train, test); the test side has ``ceil(ratio * groups)`` whole groups, drawn by hash. Null is a
    group of its own; with a unique ``group_col`` this is the split by rows. Rows are only filtered, never joined or moved."""
    last = exact_threshold(df, group_col, ratio, seed) if ratio else None
    if last is None:
        return df, df.limit(0)
    g = F.col(group_col)
    own = F.struct(hash_fraction(F.coalesce(g.cast("string"), F.lit("")), seed).alias("h"), g.isNull().alias("none"), g.cast("string").alias("g"))
    test = own <= F.struct(F.lit(last.h).alias("h"), F.lit(last.none).alias("none"), F.lit(last.g).cast("string").alias("g"))
    return df.where(~test), df.where(test)


def assign_split(df: DataFrame, group_col: str, validation_test_ratio: float = 0.2,
                 validation_ratio_from_validation_test: float = 0.5, seed: int = 42) -> DataFrame:
    """SPL-2: ``split`` column train/validation/test with the two thresholds on one hash."""
    f = hash_fraction(group_col, seed)
    test_cut = validation_test_ratio * validation_ratio_from_validation_test
    return df.withColumn("split", F.when(f < F.lit(test_cut), F.lit("test"))
                         .when(f < F.lit(validation_test_ratio), F.lit("validation"))
                         .otherwise(F.lit("train")))


def split_tables(df: DataFrame, split_col: str = "split") -> dict[str, DataFrame]:
    """SPL-3: one DataFrame per split name."""
    return {name: df.where(F.col(split_col) == name).drop(split_col) for name in S.SPLIT_NAMES}


def overlapping_groups(df: DataFrame, group_col: str, split_col: str = "split") -> DataFrame:
    """JON-9: groups found in more than one split (must be empty)."""
    return (df.groupBy(group_col).agg(F.countDistinct(split_col).alias("n_splits"))
              .where(F.col("n_splits") > 1))


def assert_disjoint(df: DataFrame, group_col: str, split_col: str = "split") -> None:
    if overlapping_groups(df, group_col, split_col).limit(1).count() > 0:
        raise ValueError("There is overlap between train, validation and test sets")


def groups_per_split(df: DataFrame, group_col: str, split_col: str = "split") -> DataFrame:
    """AGG-11: distinct group ids per split."""
    return df.select(split_col, group_col).distinct()


def filter_language(df: DataFrame, language: str, split_name: str, lang_col: str = "lang",
                    split_col: str = "split") -> DataFrame:
    """FLT-2: inside one split keep only rows of the given language."""
    return df.where((F.col(split_col) != split_name) | (F.col(lang_col) == language))


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """SNK-2: one parquet folder per split (``split=train`` ...)."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
