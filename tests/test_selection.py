import pytest
from plain import bleu, bleu_vector, chrf, chrf_vector, mbr
from pyspark.sql import functions as F

from pairloom.operators import selection
from pairloom.plans import catalog

G3 = ["the cat sat on the mat", "the cat sat on a mat", "a dog ran in the park", "the cat sat on the mat"]


def pool(spark, groups):
    rows = [(i, p, t) for i, texts in groups.items() for p, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, pos long, text string")


@pytest.mark.parametrize("metric, expected, chosen", [
    ("chrf", [42.731213, 40.268539, 13.23025], 0),
    ("bleu", [30.922597, 31.690466, 8.884566], 1),
    ("geo", [36.350517, 35.722944, 10.841819], 0),
])
def test_golden_choice(spark, metric, expected, chosen):
    scored = selection.mbr_utilities(pool(spark, {1: G3}), metric)
    rows = sorted((r.pos, r.text, r.partners, r.utility) for r in scored.collect())
    assert [r[3] for r in rows] == pytest.approx(expected, abs=1e-6)
    assert [r[:3] for r in rows] == [(0, G3[0], 2), (1, G3[1], 2), (2, G3[2], 2)]
    assert selection.mbr_select(scored).first().text == G3[chosen]


def test_choice_edges(spark):
    groups = {1: ["only one"], 2: ["same"] * 5, 3: ["ab", "ba", "zz"], 4: ["", "x"]}
    scored = selection.mbr_utilities(pool(spark, groups))
    rows = {r.id: (r.pos, r.text) for r in selection.mbr_select(scored).collect()}
    # under four tokens BLEU is 0, so every utility is 0 and the first candidate wins
    assert rows == {1: (0, "only one"), 2: (0, "same"), 3: (0, "ab"), 4: (0, "")}


def test_large_group_is_cut_into_tiles_and_stays_exact(spark):
    """A third of all candidates belong to one id; small blocks force a grid of tiles."""
    words = "the a cat dog sat ran on in mat park hat".split()
    hot = [" ".join(words[(i * k + k) % len(words)] for k in range(1, 8)) + f" {i % 9}" for i in range(40)]
    groups = {0: hot, **{i: hot[i : i + 4] for i in range(1, 20)}}
    cands = pool(spark, groups)
    small, tiles = selection._tiles(selection.candidate_dedup(cands), 8)
    sizes = [r["count"] for r in tiles.groupBy("id", "i", "j").count().collect()]
    assert max(sizes) <= 16 and len(sizes) > 12
    assert {r.id for r in small.select("id").distinct().collect()} == set(range(1, 20))
    for metric in ("geo", "chrf"):
        scored = selection.mbr_utilities(cands, metric, block=8)
        got = {(r.id, r.text): r.utility for r in scored.collect()}
        expected = {(i, t): u for i, texts in groups.items() for t, u in mbr(texts, metric)}
        assert got == pytest.approx(expected, abs=1e-9)
        chosen = {r.id: r.text for r in selection.mbr_select(scored).collect()}
        for i, texts in groups.items():
            ranked = [(round(u, 9), -p, t) for p, (t, u) in enumerate(mbr(texts, metric))]
            assert chosen[i] == max(ranked)[2]


def test_equals_plain_python_on_given_tables(spark, small):
    cands = catalog.candidates(spark, small)
    texts = {}
    for r in sorted(cands.collect(), key=lambda r: (r.id, r.pos)):
        texts.setdefault(r.id, []).append(r.text)
    got = {(r.id, r.text): r.utility for r in selection.mbr_utilities(cands).collect()}
    assert got == pytest.approx({(i, t): u for i, g in texts.items() for t, u in mbr(g)}, abs=1e-9)


def test_pool_order_priority_and_dedup(spark):
    schema = "id long, model string, rank int, text string"
    a = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 1, "y")], schema)
    b = spark.createDataFrame([(1, "b", 0, "y"), (1, "b", 1, "z")], schema)
    order = lambda df: [r.text for r in selection.candidate_dedup(df).orderBy("pos").collect()]
    assert order(selection.candidate_pool(a, b)) == ["x", "y", "z"]
    assert order(selection.candidate_pool(a, b, priority=(1, 0))) == ["y", "z", "x"]


def test_latest_models(spark):
    rows = [(1, m, s, "t") for m, s in (("a", 100), ("b", 300), ("c", 200), ("d", 50))]
    df = spark.createDataFrame(rows, "id long, model string, model_step long, text string")
    assert {r.model for r in selection.latest_models(df, 2).collect()} == {"b", "c"}
    assert selection.latest_models(df, 0).count() == 4


def test_regroup(spark):
    flat = spark.range(7).withColumnRenamed("id", "at").withColumn("text", F.col("at").cast("string"))
    rows = [(r.id, r.rank) for r in selection.regroup_flat(flat, "at", 3).orderBy("at").collect()]
    assert rows == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]


def test_pairs_never_become_rows(spark, small):
    plan = selection.mbr_utilities(catalog.candidates(spark, small))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tiles_are_bounded_by_rows_and_bytes(spark):
    """One id of 2,000 candidates of very different length, among small ones."""
    texts = [f"{i} " + "word " * (200 if i % 50 == 0 else i % 7) for i in range(2000)]
    cands = pool(spark, {0: texts, 1: texts[:3], 2: ["x " * 40_000, "y"]})
    small, tiles = selection._tiles(selection.candidate_dedup(cands), 64, 8000)
    assert {r.id for r in small.select("id").distinct().collect()} == {1}
    longest = max(len(t.encode()) for t in texts)
    per_tile = tiles.where("id = 0").groupBy("i", "j", "second").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    ends = per_tile.agg(F.max("n"), F.max("b"), F.max("j")).first()
    assert ends[0] <= 64 and ends[1] <= 8000 + longest and ends[2] >= 2000 // 64
    met = tiles.where("id = 0 and i = j").agg(F.count("*"), F.count_distinct("text")).first()
    assert tuple(met) == (2000, 2000)  # every candidate is in one block
    assert tiles.where("id = 2").count() >= 2  # two candidates, but too long for one block to be sure


def test_a_large_id_equals_one_tile(spark):
    """2,000 candidates in a grid and in one block, with sums by position and key."""
    texts = [f"{'a b c d e f g h'[: 3 + i % 11]} {i % 37} {i}" for i in range(2000)]
    cands = pool(spark, {0: texts}).repartition(4)
    whole = {(r.pos, r.text): (r.partners, r.chrf, r.bleu) for r in selection.mbr_utilities(cands, block=4000).collect()}
    grid = {(r.pos, r.text): (r.partners, r.chrf, r.bleu) for r in selection.mbr_utilities(cands, block=300).collect()}
    assert len(grid) == 2000 and {v[0] for v in grid.values()} == {1999}
    assert whole.keys() == grid.keys()
    assert all(whole[k][1:] == pytest.approx(grid[k][1:], abs=1e-9) for k in whole)


def test_candidates_that_share_a_position_stay_apart(spark):
    rows = [(1, 0, t) for t in G3]
    cands = spark.createDataFrame(rows, "id long, pos long, text string")
    for block in (2, 64):
        got = {r.text: (r.partners, r.utility) for r in selection.mbr_utilities(cands, block=block).collect()}
        assert got == {t: (2, pytest.approx(u, abs=1e-9)) for t, u in mbr(G3)}


def test_weights(spark):
    texts = [*G3, "the cat sat on the mat again"]
    weights = [2.0, 0.5, 1.0, 3.0, 0.0]
    rows = [(1, p, t, w) for p, (t, w) in enumerate(zip(texts, weights))]
    cands = spark.createDataFrame(rows, "id long, pos long, text string, w double")
    merged = {}
    for t, w in zip(texts, weights):
        merged[t] = merged.get(t, 0) + w

    def expected(hyp):
        others = [(t, w) for t, w in merged.items() if t != hyp]
        total = sum(w for _, w in others)
        c = sum(w * chrf(chrf_vector(hyp, t)) for t, w in others) / total
        b = sum(w * bleu(bleu_vector(hyp, t)) for t, w in others) / total
        return (c * b) ** 0.5

    for block in (2, 64):
        got = {r.text: r.utility for r in selection.mbr_utilities(cands, weight="w", block=block).collect()}
        assert got == pytest.approx({t: expected(t) for t in merged}, abs=1e-9)
    ones = cands.withColumn("w", F.lit(1.0)).where("pos < 3")
    assert {r.text: r.utility for r in selection.mbr_utilities(ones, weight="w").collect()} == pytest.approx(dict(mbr(G3)))
    none = cands.withColumn("w", F.lit(None).cast("double"))
    assert {r.utility for r in selection.mbr_utilities(none, weight="w").collect()} == {0.0}


def close(words, n):
    """Variants of one sentence, and others that share little with it."""
    base = words.split()
    near = [" ".join(w if (i + k) % 9 else f"w{k}" for i, w in enumerate(base)) for k in range(n // 4)]
    return near + [" ".join(f"{w}{k}" for w in base) for k in range(n - len(near))]


@pytest.mark.parametrize("metric", ["geo", "bleu"])
def test_choice_by_bounds_equals_the_choice_over_all_pairs(spark, small, metric):
    groups = {1: close("the quick brown fox jumps over the lazy dog again and again", 60), 2: G3, 3: ["one"], 4: ["", "x"]}
    groups[5] = ["same words here now"] * 4 + ["ab", "", "abcdef gh"]
    for cands in [pool(spark, groups)] + [catalog.candidates(spark, small)] * (metric == "geo"):
        chosen = selection.mbr_select(selection.mbr_utilities(cands, metric, block=16))
        expected = {r.id: (r.pos, r.text, pytest.approx(r.utility, abs=1e-8)) for r in chosen.collect()}
        rows = selection.mbr_choose(cands, metric, block=16).collect()
        assert {r.id: (r.pos, r.text, r.utility) for r in rows} == expected
        assert all(r.scored <= r.pairs for r in rows)
        if cands.columns == ["id", "pos", "text"]:
            share = {r.id: (r.scored, r.pairs) for r in rows}
            assert share[1][1] == 60 * 59 and share[1][0] < share[1][1] / 2


def test_bounds_hold(spark, small):
    cands = catalog.candidates(spark, small)
    distinct = selection.candidate_dedup(cands).withColumn("key", F.xxhash64("text")).withColumn("weight", F.lit(1.0))
    for metric in ("chrf", "bleu"):
        bounds = selection.mbr_bounds(distinct, metric, 4, 4, 1 << 18)
        both = bounds.join(selection.mbr_utilities(cands, metric).select("id", "pos", "partners", "utility"), ["id", "pos"])
        worst = both.agg(F.max(F.col("utility") - F.col("upper")), F.count("*")).first()
        assert worst[0] <= 1e-9 and worst[1] == distinct.count()


def test_small_tiles_are_scored_together(monkeypatch):
    """Calls go with the n-grams, not with the tiles: a thousand small sentences take a few."""
    import pyarrow as pa

    from pairloom.functions import overlap as O

    texts = ["the cat sat", "a cat sat on the mat", "", "the dog sat on the mat"]
    rows = [
        {"id": i, "pos": k, "key": k, "i": 0, "j": 0, "second": False, "text": t, "chars": t.replace(" ", ""),
         "words": t.split(), "tokens": t.split(), "weight": 1.0, "asked": k == i % 4}
        for i in range(1000) for k, t in enumerate(texts)
    ]
    batch = pa.Table.from_pylist(rows).combine_chunks().to_batches()[0]
    calls = []
    for name in ("shared_sums", "pair_overlap"):
        real = getattr(O, name)
        monkeypatch.setattr(O, name, lambda *a, real=real, name=name: calls.append(name) or real(*a))
    bounds, asked = O.tile_bounds(batch), O.tile_asked(batch)
    assert len(calls) < 20
    alone = [O.tile_bounds(batch.slice(0, 4)), O.tile_asked(batch.slice(0, 16))]
    assert bounds.slice(0, 4).to_pylist() == alone[0].to_pylist()
    assert asked.slice(0, 4).to_pylist() == alone[1].to_pylist()
