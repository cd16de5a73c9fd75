import numpy as np
import pyarrow as pa
import pytest
from plain import add, bleu, bleu_vector, chrf, chrf_vector, chrf_words, grams

from pairloom.functions import overlap as O
from pairloom.operators import metrics
from pairloom.plans import catalog

G1 = [
    (1, "the cat sat on the mat", "the cat sat on the mat"),
    (2, "The cat, sat on a mat.", "the cat sat on the mat."),
    (3, "", "a b"),
    (4, "كٔ شُر", "کٔ شُر"),
    (5, "x", "x y z w v"),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(G1, "id long, hyp string, ref string")


def test_token_prf(golden):
    rows = {r.id: r for r in metrics.token_prf(golden).collect()}
    expected = {
        1: (6, 6, 1, 1, 1), 2: (8, 7, 0.75, 6 / 7, 0.8), 3: (0, 2, 0, 0, 0), 4: (5, 5, 0.8, 0.8, 0.8), 5: (1, 5, 1, 0.2, 1 / 3),
    }
    for key, (h, r, p, rec, f1) in expected.items():
        row = rows[key]
        assert (row.hyp_tokens, row.ref_tokens) == (h, r)
        assert (row.precision, row.recall, row.f1) == pytest.approx((p, rec, f1))


def test_sentence_scores(golden):
    scored = metrics.with_sentence_scores(metrics.bleu_vectors(metrics.chrf_vectors(golden)))
    rows = {r.id: (r.chrf, r.bleu) for r in scored.collect()}
    expected = {1: (100, 100), 2: (43.151451, 16.515822), 3: (0, 0), 4: (45.952381, 0), 5: (23.809524, 0)}
    for key, value in expected.items():
        assert rows[key] == pytest.approx(value, abs=1e-6)


def test_corpus_report(golden):
    row = metrics.corpus_report(golden.repartition(3)).first()
    expected = dict(
        chrf=61.197547, bleu=37.149367, geo_mean=47.680711, accuracy=20, precision=71, recall=57.142857, f1=58.666667,
        rmse=2.04939, pearson=0.866921, r2=-0.5,
    )
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-5), name
    shown = metrics.display(metrics.corpus_report(golden)).first()
    assert (shown.chrf, shown.pearson) == (61.2, 0.867)


def test_separate_scores_equal_the_report(golden):
    row = metrics.corpus_report(golden).first()
    assert metrics.chrf_corpus(golden).first().chrf == pytest.approx(row.chrf)
    assert metrics.bleu_corpus(golden).first().bleu == pytest.approx(row.bleu)
    assert metrics.exact_match(golden).first().accuracy * 100 == pytest.approx(row.accuracy)
    assert metrics.length_stats(golden).first().asDict() == pytest.approx({k: row[k] for k in ("rmse", "pearson", "r2")})
    macro = metrics.token_prf_macro(golden).first()
    assert [100 * macro[k] for k in ("precision", "recall", "f1")] == pytest.approx([row[k] for k in ("precision", "recall", "f1")])


def test_golden_vectors(golden):
    total = metrics.chrf_vectors(golden).select("chrf_hyp", "chrf_ref", "chrf_shared").collect()
    sums = [[sum(r[c][i] for r in total) for c in range(3)] for i in range(8)]
    assert sums == [
        [40, 47, 36], [36, 42, 30], [33, 37, 25], [30, 33, 20], [27, 29, 15], [24, 25, 12], [17, 22, 13], [13, 17, 7],
    ]
    rows = metrics.bleu_vectors(golden).collect()
    assert [sum(r.bleu_correct[i] for r in rows) for i in range(4)] == [13, 7, 4, 3]
    assert [sum(r.bleu_total[i] for r in rows) for i in range(4)] == [17, 13, 10, 8]
    assert (sum(r.sys_len for r in rows), sum(r.ref_len for r in rows)) == (17, 22)


@pytest.mark.parametrize("kind", ["chrf", "bleu"])
def test_gram_rows_arrow_and_plain_python_agree(spark, small, kind):
    pairs = catalog.pairs(spark, small)
    by_rows = {}
    for r in metrics.gram_counts(pairs, kind=kind).collect():
        by_rows[r.id, r.ord] = (r.h, r.r, r.m)
    if kind == "chrf":
        arrow = metrics.chrf_vectors(pairs).select("id", "hyp", "ref", "chrf_hyp", "chrf_ref", "chrf_shared").collect()
    else:
        arrow = metrics.bleu_vectors(pairs).select("id", "hyp", "ref", "bleu_total", "bleu_total", "bleu_correct").collect()
    plain_vector = chrf_vector if kind == "chrf" else bleu_vector
    assert len(arrow) > 50
    for row in arrow:
        expected = plain_vector(row.hyp, row.ref)
        assert list(row[5]) == [m for _, _, m in expected]
        assert list(row[3]) == [h for h, _, _ in expected]
        for order, (h, r, m) in enumerate(expected, start=1):
            assert by_rows.get((row.id, order), (0, 0, 0)) == (h, r, m)


def test_corpus_scores_equal_plain_python(spark, small):
    pairs = catalog.noisy(spark, small)
    rows = pairs.collect()
    report = metrics.corpus_report(pairs).first()
    assert report.chrf == pytest.approx(chrf(add([chrf_vector(r.hyp, r.ref) for r in rows])), abs=1e-9)
    assert report.bleu == pytest.approx(bleu(add([bleu_vector(r.hyp, r.ref) for r in rows])), abs=1e-9)


def test_shared_grams_stay_exact_when_codes_must_be_renumbered():
    random = np.random.default_rng(5)
    left = [random.integers(0, 3, n) for n in (0, 1, 40, 5)]
    right = [random.integers(0, 3, n) for n in (4, 1, 30, 0)]
    lengths = [np.array([len(x) for x in side]) for side in (left, right)]
    for scale in (1, 10**9):  # large codes force the renumbering
        got = O.shared_grams(np.concatenate(left) * scale, lengths[0], np.concatenate(right) * scale, lengths[1], 6)
        for i, (a, b) in enumerate(zip(left, right)):
            for n in range(1, 7):
                assert got[i, n - 1] == (grams(a.tolist(), n) & grams(b.tolist(), n)).total()


def test_chunks_do_not_change_counts(monkeypatch):
    texts = pa.array([f"word {i % 7} and {i % 3} more" * (i % 4) for i in range(60)])
    other = pa.array([f"word {i % 5} or {i % 3}" * (i % 3) for i in range(60)])
    rows = np.arange(60)
    whole = O.pair_overlap(*O.symbols(texts, other), rows, rows, 4)
    monkeypatch.setattr(O, "CHUNK", 50)
    assert (O.pair_overlap(*O.symbols(texts, other), rows, rows, 4) == whole).all()


def test_edges(spark):
    schema = "id long, hyp string, ref string"
    empty = metrics.corpus_report(spark.createDataFrame([], schema)).first()
    assert all(v is None for v in empty)
    same = spark.createDataFrame([(1, "one two three four five", "one two three four five")] * 3, schema)
    row = metrics.corpus_report(same).first()
    assert (row.chrf, row.bleu, row.accuracy, row.pearson, row.r2) == pytest.approx((100, 100, 100, 0, 0))
    odd = spark.createDataFrame([(1, "", ""), (2, "ٔ", "ٔ"), (3, None, "a"), (4, "\U0001f600 a", "\U0001f600 b")], schema)
    assert len(metrics.token_prf(odd).collect()) == 4
    assert metrics.token_prf(odd).filter("id = 4").first().precision == 0.5


def test_row_order_and_partitions_do_not_matter(golden):
    one = metrics.corpus_report(golden.coalesce(1)).first().asDict()
    many = metrics.corpus_report(golden.orderBy("ref").repartition(7)).first().asDict()
    assert one == pytest.approx(many)


def test_a_missing_side_is_an_empty_text_in_every_metric(spark):
    rows = [("a b", "a b"), (None, "a b c d")]
    df = spark.createDataFrame(rows, "hyp string, ref string")
    report = metrics.corpus_report(df).first()
    assert report.accuracy == 50.0 and report.precision == 50.0
    assert metrics.exact_match(df).first().accuracy == 0.5
    assert metrics.length_stats(df).first().rmse == report.rmse == 8**0.5


def test_a_batch_is_coded_in_bounded_slices(monkeypatch):
    texts = pa.array([f"word {i % 7} and {i % 3} more" * (i % 4) if i % 9 else None for i in range(200)])
    other = pa.array([f"word {i % 5} or {i % 3}" * (i % 3) for i in range(200)])
    expected = [[(grams(a or "", n) & grams(b, n)).total() for n in range(1, 7)]
                for a, b in zip(texts.to_pylist(), other.to_pylist())]
    sizes, symbols = [], O.symbols
    monkeypatch.setattr(O, "CHUNK", 200)
    monkeypatch.setattr(O, "symbols", lambda *a: sizes.append(sum(len(c) for c, _ in symbols(*a))) or symbols(*a))
    assert O.batch_overlap(texts, other, 6).tolist() == expected
    assert len(sizes) > 10 and max(sizes) < 200 + 150  # a slice, and one row
    assert O.batch_overlap(texts[:0], other[:0], 6).shape == (0, 6)


def test_pairs_are_scored_in_as_many_parts_as_configured(spark, small):
    for rows in (catalog.noisy(spark, small), catalog.spread(catalog.pairs(spark, small), "id")):
        assert rows.rdd.getNumPartitions() == 8


def test_gram_rows_are_made_order_by_order(spark, capsys):
    texts = ["", "a", "ab", "a b c d", "\U0001F600b (x) \U0001F600b", None]
    df = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "id int, hyp string, ref string")
    expected = {}
    for i, t in enumerate(texts):
        sides = [["".join((x or "").split()), chrf_words(x or "")] for x in (t, texts[-1 - i])]
        for order in range(1, 9):
            h, r = (grams(side[order > 6], order if order < 7 else order - 6) for side in sides)
            if h or r:
                expected[i, order] = (h.total(), r.total(), (h & r).total())
    found = metrics.gram_counts(df)
    assert {(r.id, r.ord): (r.h, r.r, r.m) for r in found.collect()} == expected
    found.explain()
    plan = capsys.readouterr().out
    assert "array_join" not in plan and plan.count("regexp_extract_all") + plan.count("split(") < 8  # nothing made twice
