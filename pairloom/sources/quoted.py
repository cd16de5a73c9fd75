r"""Delimited files whose quoted fields hold line breaks, read in many tasks.

Spark gives such a file to one task, as a byte range cannot know whether it starts inside quotes. Here each range of
lines reports what it does to that state: for either state at its start, the state at its end and the records it
starts. Such reports combine, so the driver runs once over them, a few numbers for each range, and every range
then knows its state and the number of its first record. Records that lie in one range are put together where they
are read; only the pieces of those that cross into another range are shuffled, by record.

A quote opens a field only as its first character, and two quotes inside quotes are one, as in Spark's reader. Fields
are parsed by ``from_csv``, that reader's own parser. Blank lines outside quotes are no records. A file whose first line
ends in a carriage return and a line feed ends all lines so, and these breaks read as one line feed. Ranges follow
``spark.sql.files.maxPartitionBytes``; the files and that setting must stay as they are until the rows are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.ranges import REPORT_DDL, pieces, reports
from pairloom.sources.options import CSV_OPTIONS, option_table

def _inside_after(line: Column, sep: str, inside: bool) -> Column:
    """Whether a quoted field is open at the end of ``line``, given whether one is at its start."""

    def after(state: Column, field: Column) -> Column:
        opened = F.when(state, field).when(F.startswith(field, F.lit('"')), F.substring(field, F.lit(2), F.length(field)))
        # what is left of a run of quotes after its pairs is the closing one
        closed = F.contains(F.replace(opened, F.lit('""'), F.lit("")), F.lit('"'))
        return F.coalesce(~closed, F.lit(False))

    fields = F.split(line, f"\\Q{sep}\\E", -1)
    return F.when(F.contains(line, F.lit('"')), F.aggregate(fields, F.lit(inside), after)).otherwise(inside)


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(path, block, value, then_out, then_in, blank, returns) of every line: the state after it from either state, and
    how it ends. Lines of a range follow each other as in the file."""
    value = F.col("value")
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
            _inside_after(value, sep, False).alias("then_out"),
            _inside_after(value, sep, True).alias("then_in"),
            value.isin("", "\r").alias("blank"),
            F.endswith(value, F.lit("\r")).alias("returns"),
        )
    )


RANGES = pa.schema(
    {"path": pa.string(), "block": pa.int64(), "file": pa.int64(), "inside": pa.bool_()}
    | {"first": pa.int64(), "header": pa.int64(), "crlf": pa.bool_()}
)


def _ranges(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(path, block, file, inside, first, header, crlf) of every range: the number of its file, its state at the start,
    the number of its first record and of the file's first record, and how the file's lines end. Only records after a
    file's first are counted, so a header has the number before its file's rows."""
    found = lines.drop("value").mapInArrow(reports, REPORT_DDL).collect()
    rows: list[dict] = []
    total, number, file, path = 0, 0, -1, None
    inside = crlf = False
    for r in sorted(found, key=lambda r: (r["path"], r["block"])):
        if r["path"] != path:
            total = max(total, number)
            path, file, number, inside, crlf = r["path"], file + 1, total - 1, False, r["returns"]
        place = {"path": path, "block": r["block"], "file": file, "inside": inside}
        rows.append(place | {"first": number, "header": total - 1, "crlf": crlf})
        number += r["records_in"] if inside else r["records_out"]
        inside = r["end_in"] if inside else r["end_out"]
    table = pa.Table.from_pylist(rows, schema=RANGES)
    return option_table(spark, **{name: table.column(name).combine_chunks() for name in RANGES.names})


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(path, block, record, text) of every record but the headers: its file, the byte range it starts in, its number over
    all files in the order of paths, and its text. Runs a job over the files, for the states."""
    lines = _lines(spark, path, sep)
    ranges = _ranges(spark, lines)
    placed = lines.drop("returns").join(F.broadcast(ranges), ["path", "block"])
    schema = "file bigint, block bigint, record bigint, piece bigint, cut boolean, text string"
    parted = placed.mapInArrow(pieces, schema)
    whole = parted.where(~F.col("cut")).select("file", "block", "record", "text")
    parts = F.array_sort(F.collect_list(F.struct("block", "piece", "text"))).alias("parts")
    joined = parted.where("cut").groupBy("file", "record").agg(parts).select(
        "file", F.col("parts")[0]["block"].alias("block"), "record", F.array_join("parts.text", "\n").alias("text")
    )
    files = ranges.groupBy("file").agg(F.min("path").alias("path"))
    return whole.unionByName(joined).join(F.broadcast(files), "file").drop("file")


def read_quoted(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, str, str]:
    """Header files with every column as text, and the names of two columns in front: the origin (file, block), and the
    row's number over all files, from 0 in the order of paths and rows."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    columns = spark.read.options(**CSV_OPTIONS, sep=sep).csv(path).columns
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{name} string" for name in names)
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    fields = F.from_csv("text", schema, {**options, "sep": sep})
    parsed = read_records(spark, path, sep).withColumn("fields", fields)
    origin, record = (_free(columns, name) for name in ("_origin", "_record"))
    table = parsed.select(
        F.struct(F.col("path").alias("file"), "block").alias(origin),
        F.col("record").alias(record),
        *[F.col(f"fields.{name}").alias(column) for name, column in zip(names, columns, strict=True)],
    )
    return table, origin, record


def _free(columns: list[str], wanted: str) -> str:
    while wanted.lower() in {c.lower() for c in columns}:
        wanted += "_"
    return wanted
