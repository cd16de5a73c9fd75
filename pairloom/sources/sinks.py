"""Writers, and tables staged between jobs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.sources.options import CSV_OPTIONS
from pairloom.sources.readers import Rules

CSV_WRITE = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*by).options(**CSV_WRITE, sep=sep).csv(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One directory per split."""
    if fmt == "csv":
        write_csv(df, path, mode=mode, by=("split",))
    else:
        df.write.mode(mode).partitionBy("split").format(fmt).save(path)


def submission(df: DataFrame, id_col: str, text_col: str, text_name: str = "kashmiri_text") -> DataFrame:
    return df.select(F.col(id_col), F.col(text_col).alias(text_name))


def write_submission(
    df: DataFrame, id_col: str, text_col: str, path: str, text_name: str = "kashmiri_text", mode: str = "errorifexists"
) -> None:
    write_csv(submission(df, id_col, text_col, text_name), path, mode=mode)


def write_scored(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The evaluation table: the input columns and the prediction."""
    write_csv(df, path, mode=mode)


def write_variants(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All spelling variants in one pass, one directory each."""
    write_csv(df, path, mode=mode, by=("variant",))


def write_leaderboard(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sorted trial table as TSV. Sorted output parts keep the order across files."""
    write_csv(df, path, sep="\t", mode=mode)


def write_rules(char_map: DataFrame, rules: Rules, path: str, mode: str = "errorifexists") -> None:
    """Rules as one JSON document: ``char_map`` (from_ch, to_ch; alphabet-sized) plus the given suffixes."""
    pairs = F.collect_list(F.struct("from_ch", "to_ch"))
    suffixes = json.dumps([{"suffix": s, "attach": a} for s, a in rules.suffixes], ensure_ascii=False)
    schema = "array<struct<suffix:string,attach:boolean>>"
    document = char_map.agg(F.map_from_entries(pairs).alias("char_map")).select(
        "char_map", F.from_json(F.lit(suffixes), schema).alias("suffixes")
    )
    document.coalesce(1).write.mode(mode).json(path)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables; a fresh local one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="pairloom-")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, columnar, and a lost executor costs
    a re-read, not a recomputation."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/pairloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialise(df: DataFrame, folder: str, inputs: dict, refresh: bool = False) -> DataFrame:
    """Write ``df`` once and reuse it while ``inputs`` (paths, versions, options) stay the same.

    The path carries a fingerprint of ``inputs`` and the schema, so a change never meets a stale table.
    A half-written table has no ``_SUCCESS`` file and is written again.
    """
    spark = df.sparkSession
    described = json.dumps([inputs, df.schema.jsonValue()], sort_keys=True, default=str)
    path = f"{folder.rstrip('/')}/{hashlib.sha256(described.encode()).hexdigest()[:24]}"
    if refresh or not _finished(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_versions(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of every file that ``df`` reads, by path. Folders are listed once each; no job runs."""
    spark = df.sparkSession
    wanted = set(df.inputFiles())
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for folder in sorted({path.rsplit("/", 1)[0] for path in wanted}):
        # names in ``inputFiles`` are encoded as in a URI, as are those of a status
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for status in at.getFileSystem(conf).listStatus(at):
            name = f"{folder}/{status.getPath().toUri().getRawPath().rsplit('/', 1)[1]}"
            if name in wanted:
                found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def materialise_from(
    source: DataFrame, folder: str, options: dict, build: Callable[[], DataFrame], refresh: bool = False
) -> DataFrame:
    """The table that ``build`` makes of ``source``, written once and reused while the files that ``source`` reads, its
    schema and ``options`` stay the same. That is checked first: with a table in place, ``build`` is not called and no
    job reads ``source``. A source that reads no files is known by schema and ``options`` alone."""
    spark = source.sparkSession
    described = json.dumps([file_versions(source), source.schema.jsonValue(), options], sort_keys=True, default=str)
    path = f"{folder.rstrip('/')}/{hashlib.sha256(described.encode()).hexdigest()[:24]}"
    if refresh or not _finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
