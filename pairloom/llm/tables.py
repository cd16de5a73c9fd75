"""Tables read by name, staged tables in the shared folder, filters of whole rows, and column names that meet no other."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MARKS = 1 << 24  # bits that stand for keys
MAP_BITS = 1 << 15  # of one of Spark's bitmaps


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new one, which only local mode can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
    return folder.rstrip("/")


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is computed once and a lost executor
    costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/llm/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def where_arrow(df: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` through ``keep``, which filters its batches and finds columns by place: names may hold dots."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*df.columns)


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by their names as they are, dots and backticks included."""
    return df.select([F.col("`" + c.replace("`", "``") + "`") for c in columns])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _mark(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(MARKS))


def key_marks(df: DataFrame, key: str) -> np.ndarray:
    """The bits that the keys of ``df`` set among MARKS, packed: 2 MB whatever the table's size."""
    cells = df.select(_mark(key).alias("cell"))
    maps = cells.groupBy(F.floor(F.col("cell") / MAP_BITS).alias("map")).agg(
        F.bitmap_construct_agg(F.col("cell") % MAP_BITS).alias("bits")
    )
    marks = np.zeros((MARKS // MAP_BITS, MAP_BITS // 8), np.uint8)
    for row in maps.toLocalIterator():
        marks[row["map"]] = np.frombuffer(row["bits"], np.uint8)
    return marks.ravel()


def having(df: DataFrame, key: str, marks: np.ndarray, has: bool = True) -> DataFrame:
    """The rows whose key has a mark: all with a marked key, and a few others. Or, with ``has`` false, the rest."""

    @F.arrow_udf("boolean")
    def marked(column: pa.Array) -> pa.Array:
        cells = column.to_numpy(zero_copy_only=False)
        return pa.array((marks[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1)

    return df.where(marked(_mark(key)) == has)
