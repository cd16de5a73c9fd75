import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators import corpus, orthography, trials
from pairloom.plans import flows
from pairloom.sources import readers, sinks

KAS = "کٲشُر زبان"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_parallel_by_name_and_by_position(spark, tmp_path):
    named = put(tmp_path / "n.tsv", f'id\ttgt\tsrc\n1\t{KAS}\t"two\nlines ""q"""\n2\tNA\tnone\n')
    rows = readers.read_parallel(spark, named).orderBy("pair_id").collect()
    assert [(r.source, r.target) for r in rows] == [('two\nlines "q"', KAS), ("none", "NA")]
    positional = put(tmp_path / "p.tsv", f"kas\ten\n{KAS}\thello\n")
    assert [(r.source, r.target) for r in readers.read_parallel(spark, positional).collect()] == [("hello", KAS)]


def test_file_order_survives_packing(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(5):  # later files are larger, so Spark schedules them first
        put(folder / f"{i}.tsv", "src\ttgt\n" + "".join(f"same\t{i}-{j}\n" for j in range(10 * (i + 1))))
    pairs = readers.read_parallel(spark, str(folder), multi_line=False)
    assert corpus.dedup_first(pairs, ["source"], ["origin", "pair_id"]).first().target == "0-0"


def test_id_text_needs_two_columns(spark, tmp_path):
    df = readers.read_id_text(spark, put(tmp_path / "a.csv", "ID,kashmiri_text,more\n7,x,y\n"))
    assert df.columns == ["ID", "kashmiri_text"] and df.first().kashmiri_text == "x"
    with pytest.raises(ValueError):
        readers.read_id_text(spark, put(tmp_path / "b.csv", "ID\n7\n"))


def test_csv_round_trip(spark, tmp_path):
    texts = ['a "quoted", text ', "two\nlines", "tab\tend\t", "back\\slash", " lead", KAS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "")], "ID long, t string")
    sinks.write_submission(df, "ID", "t", str(tmp_path / "s"))
    back = readers.read_table(spark, str(tmp_path / "s"), "ID long, kashmiri_text string").orderBy("ID").collect()
    assert [r.kashmiri_text for r in back] == [*texts, None]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_submission(df, "ID", "t", str(tmp_path / "s"))


def test_rules_files(spark, tmp_path):
    path = put(tmp_path / "r.json", json.dumps({"char_map": {"á": "a"}, "suffixes": [{"suffix": "x", "attach": True}, {"suffix": "y"}]}))
    rules = readers.read_rules(spark, path)
    assert rules == readers.Rules({"á": "a"}, [("x", True), ("y", False)])
    assert readers.read_rules(spark, str(tmp_path / "absent.json")) == readers.Rules()
    new = spark.createDataFrame([("á", "e"), ("ñ", "n")], "from_ch string, to_ch string")
    merged = orthography.merge_char_map(readers.rules_table(spark, rules), new)
    sinks.write_rules(merged, rules, str(tmp_path / "out"))
    assert readers.read_rules(spark, str(tmp_path / "out")) == readers.Rules({"á": "e", "ñ": "n"}, rules.suffixes)


def test_leaderboard_file(spark, tmp_path):
    df = spark.createDataFrame([("t0", 4, 3e-5, 1.5), ("t1", 8, 5e-5, None)], "trial string, lora_r int, learning_rate double, geo_mean double")
    sinks.write_leaderboard(trials.leaderboard(df), str(tmp_path / "l"))
    back = readers.read_table(spark, str(tmp_path / "l"), df.schema.simpleString()[7:-1].replace(":", " "), sep="\t")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_variants_and_scored_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "ے")], "ID long, kashmiri_text string")
    sinks.write_variants(orthography.expand_variants(df, "kashmiri_text"), str(tmp_path / "v"))
    assert {p.name for p in (tmp_path / "v").glob("variant=*")} == {
        f"variant={n}" for n in ("baseline", "kashmiri", "arabic", "perso", "arabic_with_kvowels")
    }
    sinks.write_scored(df, str(tmp_path / "sc"))
    assert readers.read_raw_csv(spark, str(tmp_path / "sc")).columns == ["ID", "kashmiri_text"]


def test_materialise_reuses_until_inputs_change(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(value):
        calls.add(1)
        return value

    df = spark.range(3).select(F.udf(counted, "long")("id").alias("id"))
    for inputs, expected in (({"v": 1}, 3), ({"v": 1}, 3), ({"v": 2}, 6)):
        table = sinks.materialise(df, str(tmp_path / "cache"), inputs)
        assert table.count() == 3 and calls.value == expected
    sinks.materialise(df, str(tmp_path / "cache"), {"v": 2}, refresh=True)
    assert calls.value == 9


@pytest.mark.parametrize("exact", [False, True])
def test_prepare_corpus(spark, tmp_path, exact):
    lines = [f"sentence number {i % 150}\t{KAS} {i}" for i in range(200)] + ["\tx", "blank target\t "]
    tsv = put(tmp_path / "c.tsv", "src\ttgt\n" + "\n".join(lines) + "\n")
    sizes = {r.split: r.n for r in flows.prepare_corpus(spark, tsv, str(tmp_path / "out"), exact=exact).collect()}
    assert sum(sizes.values()) == 150
    if exact:
        # 0.1 / 0.9 * 135 is a little over 15 in floating point, and the size rounds up
        assert sizes == {"test": 15, "val": 16, "train": 119}
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 150 and set(written.columns) == {"source", "target", "split"}
    assert {r.target for r in written.filter("source = 'sentence number 7'").collect()} == {f"{KAS} 7"}


def test_nothing_is_written_when_a_guard_fails(spark, tmp_path):
    swapped = put(tmp_path / "c.tsv", f"tgt\tsrc\nplain words\t{KAS}\n")
    with pytest.raises(ValueError):
        flows.prepare_corpus(spark, swapped, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_choose_and_evaluate(spark, tmp_path):
    rows = [(1, "m", 1, p, t) for p, t in enumerate(["the cat sat on the mát", "the cat sat on a mat", "a dog ran in the park"])]
    cands = spark.createDataFrame(rows, "id long, model string, model_step long, pos long, text string")
    chosen = flows.choose_candidates(cands, readers.Rules({"á": "a"}))
    assert chosen.first().text == "the cat sat on the mat"
    refs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "beyond the first row")], "id long, ref string")
    report = flows.evaluate(chosen.select("id", "text"), refs, "id", "text", "ref", n=1, out=str(tmp_path / "scored"))
    assert report.first().chrf == pytest.approx(100)
    assert readers.read_raw_csv(spark, str(tmp_path / "scored")).count() == 1
    with pytest.raises(ValueError):
        flows.evaluate(chosen.select("id", "text"), refs, "id", "text", "ref", n=2)


def test_stage_writes_to_the_shared_folder(spark):
    staged = sinks.stage(spark.range(4))
    folder = spark.conf.get("spark.checkpoint.dir", None) or "pairloom-"
    assert staged.count() == 4 and all(folder in f for f in staged.inputFiles())


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\nx,1\ny,2\n")
    rows = readers.read_table(spark, str(tmp_path / "t.csv"), "a int, b string").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "t.csv"), "c int")


def test_a_tsv_is_read_in_several_tasks(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("src\ttgt\n" + "some words\tother words\n" * 20_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        pairs = readers.read_parallel(spark, str(tmp_path / "t.tsv"), multi_line=False)
        assert pairs.count() == 20_000 and pairs.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_table_is_reused_until_its_source_changes(spark, tmp_path):
    """Names with a space and a per cent sign; a changed file is noticed without the caller saying so."""
    source = str(tmp_path / "my 100% source")
    calls = []

    def table():
        df = spark.read.schema("id long").parquet(source)
        return sinks.materialise_from(df, str(tmp_path / "cache"), {"v": 1}, lambda: calls.append(1) or df.where("id > 0"))

    spark.range(3).write.parquet(source)
    assert [table().count(), table().count()] == [2, 2] and len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert table().count() == 4 and len(calls) == 2
    assert len(sinks.file_versions(spark.read.parquet(source))) == len(spark.read.parquet(source).inputFiles())
