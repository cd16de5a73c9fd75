"""Readers. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom.sources.options import CSV_OPTIONS, option_table
from pairloom.sources.quoted import read_quoted

RULES_SCHEMA = "char_map map<string,string>, suffixes array<struct<suffix:string,attach:boolean>>"


def read_table(
    spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", multi_line: bool = True
) -> DataFrame:
    """A parquet table, or with ``schema`` a header CSV. CSV columns are found by name, in the order of the schema. A
    cell that does not parse is null; ``read_checked`` keeps account of such cells."""
    if schema is None:
        return spark.read.parquet(path)
    raw = read_raw_csv(spark, path, sep, multi_line)
    wanted = _wanted(raw, schema, path)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def read_checked(spark: SparkSession, path: str, schema: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """A header CSV in two tables: the rows that parse, and (file, row, column, value) of every cell that does not, with
    the row's number over all files. A row with such a cell is in the second table only; empty cells are null and parse."""
    raw, origin, row = read_quoted(spark, path, sep)
    wanted = _wanted(raw, schema, path)
    cell = {f.name: F.col(f"`{f.name}`") for f in wanted}
    wrong = {f.name: cell[f.name].isNotNull() & cell[f.name].try_cast(f.dataType).isNull() for f in wanted}
    good = raw.where(~F.greatest(F.lit(False), *wrong.values(), F.lit(False)))
    good = good.select(*[cell[f.name].try_cast(f.dataType).alias(f.name) for f in wanted])
    cells = [F.struct(F.lit(n).alias("column"), cell[n].alias("value"), wrong[n].alias("wrong")) for n in cell]
    rejected = raw.select(F.col(origin)["file"].alias("file"), F.col(row).alias("row"), F.inline(F.array(*cells)))
    return good, rejected.where("wrong").drop("wrong")


def _wanted(raw: DataFrame, schema: str, path: str) -> StructType:
    wanted = StructType.fromDDL(schema)
    missing = [f.name for f in wanted if f.name not in raw.columns]
    if missing:
        raise ValueError(f"no column {missing} in {path}, found {raw.columns}")
    return wanted


def read_raw_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A header CSV with every column as text. ``multi_line`` allows line breaks inside quotes; it costs a job that finds
    where quotes are open (see ``quoted``), and files are read in many tasks either way."""
    if multi_line:
        table, origin, row = read_quoted(spark, path, sep)
        return table.drop(origin, row)
    return spark.read.options(**{**CSV_OPTIONS, "multiLine": False}, sep=sep).csv(path)


def read_parallel(
    spark: SparkSession, path: str, src: str = "src", tgt: str = "tgt", multi_line: bool = True
) -> DataFrame:
    """A parallel TSV as (origin, pair_id, source, target).

    Named columns win; without them the file is read by position, target first.
    File order is ``origin`` (file, block), then ``pair_id``, however the scan is packed into tasks.
    ``multi_line`` allows line breaks inside quotes, at the cost of a job that finds where quotes are open; ``pair_id``
    then numbers the rows of all files from 0.
    """
    if multi_line:
        raw, origin_name, row = read_quoted(spark, path, "\t")
        columns = [c for c in raw.columns if c not in (origin_name, row)]
        origin, pair_id = F.col(origin_name), F.col(row)
    else:
        raw = spark.read.options(**{**CSV_OPTIONS, "multiLine": False}, sep="\t").csv(path)
        columns, pair_id = raw.columns, F.monotonically_increasing_id()
        file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
        origin = F.struct(file, block)
    if src in columns and tgt in columns:
        source, target = F.col(f"`{src}`"), F.col(f"`{tgt}`")
    else:
        require_columns(raw.select(*[F.col(f"`{c}`") for c in columns]), 2)
        source, target = F.col(f"`{columns[1]}`"), F.col(f"`{columns[0]}`")
    return raw.select(
        origin.alias("origin"), pair_id.alias("pair_id"), source.alias("source"), target.alias("target")
    )


def require_columns(df: DataFrame, n: int) -> None:
    if len(df.columns) < n:
        raise ValueError(f"expected at least {n} columns, found {df.columns}")


def read_id_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV by position: the first column is the id, the second the text; names are kept."""
    raw = read_raw_csv(spark, path, multi_line=multi_line)
    require_columns(raw, 2)
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns[:2]])


@dataclass
class Rules:
    """Spelling rules: single-character replacements, then suffixes as (suffix, attach)."""

    char_map: dict[str, str] = field(default_factory=dict)
    suffixes: list[tuple[str, bool]] = field(default_factory=list)


def read_rules(spark: SparkSession, path: str) -> Rules:
    """A rules file (one JSON document, as long as the alphabet at most). No file: no rules."""
    try:
        row = spark.read.schema(RULES_SCHEMA).json(path, multiLine=True).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    if row is None:
        return Rules()
    return Rules(dict(row.char_map or {}), [(s.suffix or "", bool(s.attach)) for s in row.suffixes or []])


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The character map as rows (from_ch, to_ch)."""
    old, new = list(rules.char_map), list(rules.char_map.values())
    return option_table(spark, from_ch=pa.array(old, pa.string()), to_ch=pa.array(new, pa.string()))
