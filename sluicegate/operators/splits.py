"""Splits by position in time, and walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_bounds(n: int, train: float = 0.6, validate: float = 0.2) -> tuple[int, int]:
    """Positions where validation and test begin, truncated as Python does."""
    return int(n * train), int(n * (train + validate))


def temporal_split(df: DataFrame, n: int, position: str = "position", train: float = 0.6, validate: float = 0.2) -> DataFrame:
    a, b = split_bounds(n, train, validate)
    return df.withColumn("split", F.when(F.col(position) < a, "train").when(F.col(position) < b, "val").otherwise("test"))


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(df.where(F.col("split") == s) for s in ("train", "val", "test"))


@dataclass(frozen=True)
class Fold:
    number: int
    train_end: int  # positions before it are trained on
    test_end: int  # positions from train_end up to it are tested on


def walk_forward(n: int, folds: int, first: float = 0.5) -> list[Fold]:
    """Growing training ranges, each with the next block as its test; rows left over are dropped."""
    start = int(n * first)
    block = (n - start) // folds if folds > 0 else 0
    if block <= 0 or start <= 0:
        raise ValueError("too few rows for so many folds")
    return [Fold(k + 1, start + k * block, start + (k + 1) * block) for k in range(folds)]


def batch_slice(df: DataFrame, start: int, size: int, position: str = "position") -> DataFrame:
    return df.where((F.col(position) >= start) & (F.col(position) < start + size))


def reference_slice(df: DataFrame, start: int, size: int, position: str = "position") -> DataFrame:
    """The batch before `start`."""
    return df.where((F.col(position) >= max(0, start - size)) & (F.col(position) < start))
