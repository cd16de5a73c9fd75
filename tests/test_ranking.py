import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import corpus, encoding, ranking


def test_ranks_over_many_ranges(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    ranked = ranking.with_rank(df, F.desc("a"), F.asc("b")).orderBy("rank").collect()
    assert [(r.a, r.b) for r in ranked] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r["rank"] for r in ranked] == list(range(1, 5001))
    assert ranking.with_rank(df.limit(0), F.asc("a")).count() == 0


@pytest.mark.parametrize("n", [1, 700, 1500, 2999, 3000, 3001])
def test_order_statistic(spark, n):
    """A third of all keys are one key, and some are null."""
    rng = random.Random(4)
    keys = [None] * 20 + [7] * 1000 + [rng.randrange(-500, 500) for _ in range(1980)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "`k.1` long, t string").repartition(5)
    ordered = sorted(keys, key=lambda k: (k is not None, k or 0))
    found = ranking.order_statistic(df, ["k.1"], n)
    if n > 3000:
        assert found is None
    else:
        last = ordered[n - 1]
        assert (found[0][0], found[1]) == (last, ordered[:n].count(last))
    head = [r[0] for r in corpus.head_n(df, ["k.1"], n).collect()]
    assert sorted(head, key=lambda k: (k is not None, k or 0)) == ordered[:n]


def test_head_of_a_pair_of_keys_and_of_ties(spark):
    df = spark.createDataFrame([(i % 3, None if i % 5 == 0 else f"s{i % 4}", i) for i in range(300)], "a int, b string, c int")
    got = sorted(r.c for r in corpus.head_n(df, ["a", "b"], 30).collect())
    ranked = sorted(range(300), key=lambda i: (i % 3, i % 5 != 0, "" if i % 5 == 0 else f"s{i % 4}", i))
    assert got == sorted(ranked[:30])
    assert corpus.head_n(df.select("a"), ["a"], 7).count() == 7  # of rows that are all alike, as many as asked


def test_vocabulary_larger_than_the_pieces(spark):
    words = [f"w{i}" for i in range(40) for _ in range(1 + i % 4)]
    df = spark.createDataFrame([(words,)], "pieces array<string>")
    expected = sorted(set(words), key=lambda w: (-words.count(w), w))
    for size in (1, 15, 1000):
        vocab = encoding.build_vocab(df, size=size).orderBy("piece_id").collect()
        assert [r.piece for r in vocab] == ["<s>", "<pad>", "</s>", "<unk>", *expected[:size]]
        assert [r.piece_id for r in vocab] == list(range(len(vocab)))
    plan = encoding.build_vocab(df, size=1000)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
