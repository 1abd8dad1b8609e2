"""Readings of the project's tables that several problems share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.session import table

# Spellings of the splits after trimming and lower-casing.
TRAINING = ["train", "training"]
VALIDATION = ["val", "validation", "dev"]
TEST = ["test"]


def split_of(c: Column | str) -> Column:
    """training, validation or test; null for a null or any other value."""
    s = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(s.isin(TRAINING), "training").when(s.isin(VALIDATION), "validation").when(s.isin(TEST), "test")


def synthetic_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated tasks, all rows."""
    return table(spark, sf_dir, "synthetic_task")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl, all rows."""
    return table(spark, sf_dir, "documents")
