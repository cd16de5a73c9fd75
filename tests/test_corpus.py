import hashlib
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pairloom.functions import text as T
from pairloom.operators import corpus
from pairloom.plans import catalog

SPLITS = ("train", "val", "test")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, source string, target string")


def test_clean_and_dedup(spark):
    rows = [(1, "  hi ", "x"), (2, "\xa0", "x"), (3, "a", "1"), (4, "a ", "2"), (5, None, "x"), (6, "b", None), (7, "b", "\n")]
    kept = corpus.dedup_first(corpus.clean_pairs(pairs(spark, rows)), ["source"], ["pair_id"])
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "hi", "x"), (3, "a", "1")]


@pytest.mark.parametrize("partitions", [1, 7])
def test_dedup_does_not_depend_on_partitions_and_takes_a_hot_key(spark, partitions):
    # one text makes up a third of the rows
    df = spark.range(9000).select(
        F.col("id").alias("pair_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("source"),
        F.col("id").cast("string").alias("target"),
    )
    kept = corpus.dedup_first(df.repartition(partitions, "target"), ["source"], ["pair_id"]).collect()
    first = {}
    for i in range(9000):
        first.setdefault("hot" if i % 3 == 0 else str(i % 500), i)
    assert {r.source: r.pair_id for r in kept} == first
    assert all(r.target == str(r.pair_id) for r in kept)


def test_script_guards(spark):
    good = pairs(spark, [(i, "plain words", "کٲشُر زبان") for i in range(5)])
    swapped = good.select("pair_id", F.col("target").alias("source"), F.col("source").alias("target"))
    latin = pairs(spark, [(1, "plain words", "more words")])
    corpus.require_scripts(good)
    corpus.require_target_script(good)
    for bad in (swapped, latin):
        with pytest.raises(ValueError):
            corpus.require_scripts(bad)
    with pytest.raises(ValueError):
        corpus.require_target_script(latin)
    # only the first rows count
    corpus.require_scripts(good.unionByName(pairs(spark, [(i, "ک", "x" * 999) for i in range(100, 110)])), n=5)


def test_arabic_extended_counts_for_columns_but_not_for_the_target_guard(spark):
    extended = pairs(spark, [(1, "words", "ࢠࢡ")])
    corpus.require_scripts(extended)
    with pytest.raises(ValueError):
        corpus.require_target_script(extended)


def test_pick_column(spark):
    df = spark.createDataFrame([(1, "a", "b")], "ID long, sentence string, extra string")
    assert corpus.pick_column(df, "sentence", 1) == "sentence"
    assert corpus.pick_column(df, "missing", 1) == "sentence"
    assert corpus.pick_column(df, None, "kashmiri_text") == "extra"


def test_hash_split_is_stable_and_near_its_fractions(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    split = corpus.hash_split(df, "k", val=0.1, test=0.2)
    sizes = {r.split: r.n for r in corpus.split_sizes(split).collect()}
    assert sum(sizes.values()) == 20000
    assert abs(sizes["test"] - 4000) < 300 and abs(sizes["val"] - 2000) < 300
    before = {r.k: r.split for r in split.collect()}
    again = {r.k: r.split for r in corpus.hash_split(df.repartition(5).limit(9000), "k", val=0.1, test=0.2).collect()}
    assert all(before[k] == s for k, s in again.items())


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_exact_split_sizes_and_order(spark, n):
    rows = {r.id: r.split for r in corpus.exact_split(spark.range(n), "id", val=0.1, test=0.1).collect()}
    n_test = math.ceil(0.1 * n)
    n_val = math.ceil(0.1 / 0.9 * (n - n_test))
    ranked = sorted(range(n), key=lambda i: hashlib.md5(f"{i}#42".encode()).hexdigest())
    expected = ["test"] * n_test + ["val"] * n_val
    expected += ["train"] * (n - len(expected))
    assert rows == dict(zip(ranked, expected))


def test_sample(spark):
    got = {r.id for r in corpus.seeded_sample(spark.range(3000), "id", 700).collect()}
    ranked = sorted(range(3000), key=lambda i: hashlib.md5(f"{i}#42".encode()).hexdigest())
    assert got == set(ranked[:700])
    assert corpus.seeded_sample(spark.range(30), "id", 700).count() == 30
    assert corpus.seeded_sample(spark.range(30), "id", 0).count() == 0


def test_null_and_repeated_keys_keep_all_rows(spark):
    rows = [(None, 0), (None, 1), *[("same", i) for i in range(60)], *[(str(i), i) for i in range(40)]]
    df = spark.createDataFrame(rows, "k string, i int")
    split = corpus.exact_split(df, "k").collect()
    assert len(split) == len(rows)
    for key in (None, "same"):
        assert len({r.split for r in split if r.k == key}) == 1
    assert corpus.seeded_sample(df, "k", 1000).count() == len(rows)
    unique = corpus.seeded_sample(df.filter("k <> 'same'"), "k", 10).collect()
    assert len(unique) in (10, 11)


def test_no_text_is_sorted_or_shuffled_for_a_cut(spark, small):
    for name in ("exact_split", "seeded_sample", "hash_split", "prefix_source", "tokenize", "nfc_text"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "TakeOrdered" not in plan and "Window" not in plan, name


def test_split_overlap(spark):
    rows = [("a", "train"), ("a", "train"), ("b", "val"), ("c", "test"), ("a", "val"), ("c", "train")]
    df = spark.createDataFrame(rows, "k string, split string")
    assert corpus.split_overlap(df, "k").first().asDict() == {"train_val": 1, "train_test": 1, "val_test": 0}
    with pytest.raises(ValueError):
        corpus.require_disjoint(df, "k")
    corpus.require_disjoint(corpus.hash_split(df.select("k"), "k"), "k")


def test_alignment(spark):
    hyp = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, hyp string")
    ref = spark.createDataFrame([(1, "x"), (3, "y")], "id long, ref string")
    found = corpus.align_check(hyp, ref, "id").first().asDict()
    assert found == {"n_hyp": 3, "n_ref": 2, "matched": 1, "only_hyp": 1, "only_ref": 1, "repeated": 1}
    with pytest.raises(ValueError):
        corpus.align(hyp, ref, "id", strict=True)
    assert [tuple(r) for r in corpus.align(hyp.filter("id = 1"), ref.filter("id = 1"), "id", strict=True).collect()] == [(1, "x", "a")]


IDS = {
    "dense": ([3, 1, 2], [1, 2, 3], True),
    "sparse": ([70, -5, 10**12], [10**12, 70, -5], True),
    "texts": (["b", "a", ""], ["", "a", "b"], True),
    "a null each": ([1, None], [None, 1], True),
    "empty": ([], [], True),
    "repeated on both sides": ([1, 1, 3], [3, 1, 1], False),
    "same ends and number": ([1, 2, 2, 4], [1, 3, 2, 4], False),
    "one missing": ([1, 2], [1, 2, 3], False),
    "null against text": ([None, "a"], ["", "a"], False),
    "two nulls": ([None, None], [None, None], False),
}


@pytest.mark.parametrize("case", IDS)
def test_alignment_by_fingerprint_agrees_with_the_grouped_check(spark, case):
    left, right, good = IDS[case]
    kind = "string" if any(isinstance(i, str) for i in left) else "long"
    hyp, ref = (spark.createDataFrame([(i,) for i in ids], f"`pair.id` {kind}").repartition(3) for ids in (left, right))
    grouped = corpus.align_check(*(df.withColumnRenamed("pair.id", "id") for df in (hyp, ref)), "id").first()
    assert good == (not (grouped.only_hyp or grouped.only_ref or grouped.repeated))
    assert corpus._one_to_one(hyp, ref, "pair.id") == good


def test_aligned_sides_are_passed_without_a_shuffle_of_ids(spark, monkeypatch):
    hyp = spark.range(5000).select(F.col("id").cast("int"))  # narrower than the other side
    ref = spark.range(4999, -1, -1, 5)
    for side in (hyp, ref):
        plan = corpus.fingerprint(side, "id", LongType())._jdf.queryExecution().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    monkeypatch.setattr(corpus, "align_check", lambda *_: pytest.fail("grouped check"))
    grouped = type(hyp).groupBy
    monkeypatch.setattr(type(hyp), "groupBy", lambda df, *by: pytest.fail("grouping") if by else grouped(df))
    corpus.require_aligned(hyp, ref, "id")


def test_head_n(spark):
    assert sorted(r.id for r in corpus.head_n(spark.range(50).repartition(4), ["id"], 3).collect()) == [0, 1, 2]
    assert corpus.head_n(spark.range(50), ["id"], 0).count() == 50
    assert corpus.head_n(spark.range(50), ["id"], 99).count() == 50
    df = spark.createDataFrame([(None, 2), (1, 1), (1, 0)], "a int, b int")
    assert sorted((r.a or 0, r.b) for r in corpus.head_n(df, ["a", "b"], 2).collect()) == [(0, 2), (1, 0)]


def test_row_wise_operators_accept_a_stream(spark, small, tmp_path):
    fixed = spark.read.parquet(f"{small}/documents.parquet")
    fixed.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))

    def row_wise(df):
        cleaned = corpus.clean_pairs(df.select("doc_id", F.col("text").alias("source"), F.col("text").alias("target")))
        normalized = cleaned.withColumn("source", T.normalize_text(F.col("source"), catalog.FOLD, [("tion", False)]))
        return corpus.hash_split(normalized, "target").select("doc_id", "source", "split")

    query = (
        row_wise(stream).writeStream.format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(written.collect()) == sorted(row_wise(fixed).collect())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = catalog.hash_split(spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = catalog.align_check(spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
