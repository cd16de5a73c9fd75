"""The flows from file to file."""

from pathlib import Path


from pairloom.plans import flows
from pairloom.sources import readers

KAS = "کٲشُر زبان"


def test_training_table(spark, tmp_path):
    pairs = spark.createDataFrame([(i, f"plain words {i}", f"{KAS} {i % 3}") for i in range(9)], "pair_id long, source string, target string")
    folder = str(tmp_path / "t")
    table = flows.training_table(pairs, folder, {"from": "test"}, prefix="translate: ", vocab_size=50, max_len=4)
    rows = table.collect()
    assert len(rows) == 9 and all(len(r.input_ids) == 4 and r.input_ids[-1] == 2 and r.labels[-1] == 2 for r in rows)
    assert all(r.attention_mask == [1] * 4 for r in rows) and len({r.input_ids[0] for r in rows}) == 1
    assert flows.training_table(pairs, folder, {"from": "test"}, sample=4, vocab_size=50).count() == 4
    assert len([p for p in Path(folder).iterdir()]) == 2


def test_learn_spelling(spark, tmp_path):
    df = spark.createDataFrame([("x", "éee eee"), ("y", "ee")], "id string, sentence string")
    rules = readers.Rules({"a": "b"}, [("s", True)])
    merged = flows.learn_spelling(df, [["e", "é"]], str(tmp_path / "r"), rules=rules, threshold=0.8)
    assert {r.from_ch: r.to_ch for r in merged.collect()} == {"a": "b", "é": "e"}
    written = readers.read_rules(spark, str(tmp_path / "r"))
    assert written.char_map == {"a": "b", "é": "e"} and written.suffixes == [("s", True)]


def test_variant_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("ID,text\n1,été\n")
    variants = {"plain": {"é": "e"}, "grave": {"é": "è"}}
    flows.write_variant_files(spark, str(tmp_path / "in.csv"), variants, str(tmp_path / "out"), ["plain"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r.variant, r.text) for r in rows} == {("baseline", "été"), ("plain", "ete")}


def test_audit(spark):
    df = spark.createDataFrame([(1, "éee")], "ID long, prediction string")
    counts, usage = flows.audit(df, [["e", "é"]], "missing", "prediction")
    assert {(r.ch, r.n, r.name) for r in counts.collect()} == {
        ("e", 2, "LATIN SMALL LETTER E"), ("é", 1, "LATIN SMALL LETTER E WITH ACUTE"),
    }
    assert {(r.ch, r["rank"]) for r in usage.collect()} == {("e", 1), ("é", 2)}
