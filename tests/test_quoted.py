"""Quoted files with line breaks, read by byte ranges, against Spark's single-task reader."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import ranges
from pairloom.plans import flows
from pairloom.sources import quoted, readers

FIELDS = ["plain", "a b", '5" disk', "é ü", "'q'", "", '""']
QUOTED = ["two\nlines", 'say ""hi""', "tab\there", '""', '"" \n""', "a\n\nb", "\n", 'end""', '""start', "x" * 300]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges far smaller than the files."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "8k")
    spark.conf.set(names[1], "1k")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def field(rng):
    return rng.choice(FIELDS) if rng.random() < 0.4 else f'"{rng.choice(QUOTED)}"'


def write(folder, n_files, n_rows, rng):
    folder.mkdir()
    for f in range(n_files):
        rows = []
        for i in range(n_rows):
            rows.append("\t".join([str(i), field(rng), field(rng)]))
            if rng.random() < 0.02:
                rows.append("")  # no record
        body = "\n".join(["id\tsrc\ttgt", *rows]) + ("\n" if f else "")
        if f == 2:
            body = body.replace("\n", "\r\n")
        (folder / f"{f}.tsv").write_bytes((("﻿" if f == 1 else "") + body).encode())
    return str(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_single_task_reader_row_by_row(spark, tmp_path, small_ranges, seed):
    path = write(tmp_path / "f", 3, 400, random.Random(seed))
    expected = []
    for f in range(3):
        one = spark.read.options(**readers.CSV_OPTIONS, sep="\t").csv(f"{path}/{f}.tsv")
        expected += [tuple(r) for r in one.collect()]
    table, origin, row = quoted.read_quoted(spark, path, "\t")
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    rows = table.orderBy(row).collect()
    assert [r[row] for r in rows] == list(range(1200))
    assert [tuple(r)[2:] for r in rows] == expected
    assert [r[row] for r in table.orderBy(origin, row).collect()] == list(range(1200))  # origin is the files' order too


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}" for i in range(8000))
    (tmp_path / "a.csv").write_text(f'id,text\n1,"{long}"\n2,"x\ny"\n3,open "quote\n4,"unclosed\n5,z\n')
    rows = {r.id: r.text for r in readers.read_raw_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert set(rows) == {"1", "2", "3", "4"}  # what is never closed runs to the end
    assert rows["1"] == long
    one = spark.read.options(**readers.CSV_OPTIONS).csv(str(tmp_path / "a.csv"))
    assert {r.id: r.text for r in one.where("id < 4").collect()} == {k: v for k, v in rows.items() if k < "4"}


def test_states_follow_the_lines_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 12))
        then_out, then_in, inside = rng.random(n) < 0.5, rng.random(n) < 0.5, bool(rng.random() < 0.5)
        expected = [inside]
        for a, b in zip(then_out, then_in, strict=True):
            expected.append(bool(b if expected[-1] else a))
        assert ranges.states(then_out, then_in, inside).tolist() == expected


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for i, text in enumerate(["a,b\n", "a,b\n1,2", "\n\n", "a,b\n\n3,4\n"]):
        (tmp_path / "f" / f"{i}.csv").write_text(text)
    table, origin, row = quoted.read_quoted(spark, str(tmp_path / "f"))
    assert [tuple(r)[1:] for r in table.orderBy(row).collect()] == [(0, "1", "2"), (1, "3", "4")]


def test_clashing_and_dotted_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("_origin,_RECORD,a.b,text\n1,2,3,4\n")
    assert readers.read_raw_csv(spark, str(tmp_path / "a.csv")).collect()[0].asDict() == {
        "_origin": "1", "_RECORD": "2", "a.b": "3", "text": "4",
    }


def test_pair_ids_are_unique_and_in_order(spark, tmp_path, small_ranges):
    path = write(tmp_path / "f", 2, 300, random.Random(5))
    pairs = readers.read_parallel(spark, path)
    assert pairs.agg(F.count_distinct("pair_id"), F.min("pair_id"), F.max("pair_id")).first()[:] == (600, 0, 599)
    lines = "".join(f'"sentence\nnumber {i % 900}"\t"کٲشُر {i}"\n' for i in range(2000))
    (tmp_path / "c.tsv").write_text("src\ttgt\n" + lines)
    sizes = flows.prepare_corpus(spark, str(tmp_path / "c.tsv"), str(tmp_path / "out"))
    assert sum(r.n for r in sizes.collect()) == 900
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.where(F.col("source") == "sentence\nnumber 7").first().target == "کٲشُر 7"  # the first of the file


def test_rejected_cells_are_kept_apart(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "0.csv").write_text('n,when,t\n1,2020-01-02,"a\nb"\nx,2020-01-02,c\n3,,d\n')
    (tmp_path / "f" / "1.csv").write_text("n,when,t\n4,yesterday,e\ny,never,f\n")
    good, rejected = readers.read_checked(spark, str(tmp_path / "f"), "t string, n int, when date")
    assert sorted(r.t for r in good.collect()) == ["a\nb", "d"]
    assert {(r.file[-5:], r.row, r.column, r.value) for r in rejected.collect()} == {
        ("0.csv", 1, "n", "x"), ("1.csv", 3, "when", "yesterday"), ("1.csv", 4, "n", "y"), ("1.csv", 4, "when", "never"),
    }
    assert good.count() + rejected.select("row").distinct().count() == 5
