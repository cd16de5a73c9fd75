"""CSV options, and tables made of options."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "multiLine": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def option_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table made of options. As a local relation it needs no job and its size is known to the planner."""
    return spark.createDataFrame(pa.table(columns))
