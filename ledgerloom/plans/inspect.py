"""Looks at physical plans: what reaches the scan, and how often rows are shuffled."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (.*)", plan_text(df))


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan, each counted once."""
    return len(re.findall(r"^\(\d+\) Exchange", plan_text(df), re.M))
