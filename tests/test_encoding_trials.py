import pytest
from pyspark.sql import functions as F

from pairloom.operators import encoding, trials


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("a", 9, 4), ("c", 5, 6), ("<pad>", 0, 1)], "piece string, n long, piece_id long")


@pytest.mark.parametrize("most, frequent", [(3, 1000), (2, 1), (2, 3), (0, 0)])
def test_encode(spark, vocab, monkeypatch, most, frequent):
    monkeypatch.setattr(encoding, "BROADCAST_VOCAB", most)
    monkeypatch.setattr(encoding, "FREQUENT", frequent)
    rows = [(1, list("abcd")), (2, []), (3, ["c"]), (4, None)]
    df = spark.createDataFrame(rows, "id long, pieces array<string>")
    labels = {r.id: r.labels for r in encoding.encode_labels(df, vocab, max_len=4).collect()}
    assert labels == {1: [4, 3, 6, 2], 2: [2], 3: [6, 2], 4: [2]}
    inputs = {r.id: (r.input_ids, r.attention_mask) for r in encoding.encode_inputs(df, vocab, max_len=3).collect()}
    assert inputs[1] == ([4, 3, 2], [1, 1, 1]) and inputs[2] == ([2], [1])


def test_decode(spark, vocab):
    df = spark.createDataFrame([(1, [4, 3, 6, 2, -100, -100]), (2, [-100]), (3, [])], "id long, labels array<long>")
    assert {r.id: r.text for r in encoding.decode_labels(df, vocab).collect()} == {1: "a c", 2: "", 3: ""}


def test_repeated_ids_stay_apart(spark, vocab):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (None, ["a"])], "id long, pieces array<string>")
    labels = encoding.encode_labels(df, vocab)
    assert sorted((r.id or 0, r.labels) for r in labels.collect()) == [(0, [4, 2]), (1, [4, 3, 2]), (1, [6, 2])]
    assert sorted((r.id or 0, r.text) for r in encoding.decode_labels(labels, vocab).collect()) == [(0, "a"), (1, "a"), (1, "c")]


def test_nan_and_numbered_trials(spark):
    rows = [("trial_10", 0.0), ("trial_2", None), ("trial_1", float("nan")), ("trial_3", 5.0)]
    df = spark.createDataFrame(rows, "trial string, geo_mean double")
    assert [r.trial for r in trials.leaderboard(df).collect()] == ["trial_3", "trial_1", "trial_2", "trial_10"]
    steps = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "step int, geo_mean double")
    assert trials.best_step(steps).first().step == 2


def test_vocab_order_with_a_hot_piece(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 4)).alias("w"))
    rows = encoding.build_vocab(df.select(F.array("w", F.lit("<s>")).alias("pieces")), size=3).orderBy("piece_id").collect()
    assert [(r.piece, r.piece_id) for r in rows[:4]] == [("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3)]
    assert (rows[4].piece, rows[4].n, rows[4].piece_id) == ("hot", 1000, 4)
    assert [r.piece for r in rows[5:]] == ["p0", "p1"]


def test_short_rows_are_shuffled_once(spark, vocab):
    df = spark.createDataFrame([(1, ["a"])], "id long, pieces array<string>")
    plan = encoding.encode_labels(df, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_grid(spark):
    base = spark.createDataFrame([("x",), ("y",)], "name string")
    rows = trials.param_grid(base, lora_r=[4, 8, 16], learning_rate=[3e-5, 5e-5]).orderBy("name", "trial").collect()
    assert [(r.trial, r.lora_r, r.learning_rate) for r in rows[:3]] == [(0, 4, 3e-5), (1, 4, 5e-5), (2, 8, 3e-5)]
    assert len(rows) == 12


def test_log_metric(spark):
    lines = ["x {'eval_geo_mean': 78.1, 'eval_geo_mean': 5}", "none", "'eval_geo_mean':3", "'eval_geo_mean': 1.2.3", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    got = [r.eval_geo_mean for r in trials.log_metric(df, "line").orderBy("i").collect()]
    assert got == [78.1, None, 3.0, None, None]


def test_rankings(spark):
    df = spark.createDataFrame([("t0", 78.1), ("t1", None), ("t2", 79.0), ("t3", 0.0)], "trial string, geo_mean double")
    assert [r.trial for r in trials.leaderboard(df).collect()] == ["t2", "t0", "t1", "t3"]
    steps = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 7.0), ("b", 1, None)], "run string, step long, geo_mean double")
    assert [tuple(r) for r in trials.best_step(steps, by=("run",)).collect()] == [("a", 2, 7.0)]
    assert trials.best_step(steps).first().step == 2
