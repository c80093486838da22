"""Reviewed plans: a dry run writes its plan, the apply step reads exactly that plan and nothing newer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_plan(df: DataFrame, path: str, target: str) -> None:
    """The plan's rows, each stamped with the target they were computed for."""
    df.withColumn("plan_target", F.lit(target)).write.mode("overwrite").parquet(path)


def read_plan(spark: SparkSession, path: str, target: str, runs: DataFrame | None = None) -> DataFrame:
    """The stored plan; refused where it was made for another target or while an ingest run is queued or running."""
    plan = spark.read.parquet(path)
    other = plan.where(F.col("plan_target") != target).select("plan_target").first()
    if other:
        raise ValueError(f"plan was made for {other[0]}, but this run targets {target}")
    if runs is not None and runs.where(F.col("status").isin("queued", "running")).first():
        raise ValueError("an ingest run is queued or running; stop it before applying the plan")
    return plan.drop("plan_target")
