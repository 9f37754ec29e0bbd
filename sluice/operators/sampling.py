"""Deterministic samples: the same rows on every run and in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_text(keys: tuple[str, ...], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))).cast("binary"))


def first_by_hash(df: DataFrame, keys: tuple[str, ...], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a hash of their keys: a top-k, not a sort of the table."""
    return df.orderBy(hash_text(keys, seed), *keys).limit(n)


def probe_rows(df: DataFrame, chosen: Column, keys: tuple[str, ...], n: int, seed: int = 0) -> DataFrame:
    """Rows for a check: ``n`` of all and ``n`` of the ``chosen`` rare ones, by hash; who is in both comes once."""
    return first_by_hash(df, keys, n, seed).union(first_by_hash(df.where(chosen), keys, n, seed)).distinct()


def build_matrix(
    table: DataFrame, columns: tuple[str, ...], tier: int, horizon: int, kind: str = "general", negative_rate: float = 0.05, seed: int = 0, target: str = "binary",
    keys: tuple[str, ...] = ("station_code", "ts"),
) -> DataFrame:
    """``(keys, columns, y)`` of the feature table's rows to train on, or with a rate of 1 the whole population to score.

    All positives stay, negatives by hash; rows without a valid label are
    neither.  Kind ``onset`` takes rows below the tier only.  The target
    ``depth`` asks how deep instead of whether, on the same rows.
    """
    if kind not in ("general", "onset") or target not in ("binary", "depth"):
        raise ValueError(f"no matrix of kind {kind!r} with target {target!r}")
    label = F.col(f"y_ge{tier}_{horizon}h")
    rows = table.where(F.col(f"y_valid_{horizon}h") & label.isNotNull())
    if kind == "onset":
        rows = rows.where(f"is_onset_{tier}")
    if negative_rate < 1:
        rows = thinned_negatives(rows, label, keys, negative_rate, seed)
    y = label.cast("byte") if target == "binary" else F.col(f"y_maxdepth_{horizon}h").cast("double")
    return rows.select(*keys, *columns, y.alias("y"))


def thinned_negatives(df: DataFrame, positive: Column, keys: tuple[str, ...], rate: float, seed: int = 0) -> DataFrame:
    """All positives and about ``rate`` of the rest, decided row by row before any shuffle."""
    draw = F.conv(F.substring(hash_text(keys, seed), 1, 8), 16, 10).cast("long") % 1_000_000
    return df.where(positive | (draw < int(rate * 1_000_000)))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``, which should end in a unique column."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
