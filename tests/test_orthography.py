import unicodedata

from pyspark.sql import functions as F

from pairloom.operators import orthography as ortho


def points(text):
    return " ".join(f"{ord(c):04X}" for c in text)


def counts_of(spark, **n):
    return spark.createDataFrame(list(n.items()), "ch string, n long")


def test_fixed_values_are_the_documented_code_points():
    assert [points(g) for g in ortho.LEARN_GROUPS] == [
        "06CC 06D2 064A 06D0 06CE", "0648 06C4 06C6 06CF", "0647 06BE 06C2 0629", "0646 06BA", "0627 0622 0623 0625",
    ]
    assert [points(g) for g in ortho.AUDIT_GROUPS] == [
        "06CC 06D2 064A 06D0 06CE 0620", "0648 06C4 06C6 06CF", "0647 06BE 06C2 0629 06C1", "0646 06BA",
        "0627 0622 0623 0625 0672", "0643 06A9 06AA", "0657 065A 0670", "06C1 06BE",
    ]
    kashmiri = ortho.VARIANTS["kashmiri"]
    assert points(kashmiri) == "06D2 064A 06D0 06CE 06C6 06CF 06BE 06C2 0629 06BA 0623 0625 0643 06AA"
    for mapping in ortho.VARIANTS.values():
        for k, v in mapping.items():
            assert k != v and unicodedata.normalize("NFC", k) == k and unicodedata.normalize("NFC", v) == v
            assert v not in mapping  # targets are fixed points, so applying twice changes nothing


def test_char_counts(spark):
    df = spark.createDataFrame([("é a",), ("éa\n",), ("",), (None,)], "t string")
    rows = {r.ch: (r.n, r.pct) for r in ortho.char_counts(df, "t").collect()}
    assert rows == {"é": (2, 100 / 3), "a": (2, 100 / 3), " ": (1, 100 / 6), "\n": (1, 100 / 6)}
    top = ortho.top_chars(ortho.char_counts(df, "t"), 2, names=True).collect()
    assert [(r.ch, r.label, r.name) for r in top] == [
        ("a", "U+0061", "LATIN SMALL LETTER A"), ("é", "U+00E9", "LATIN SMALL LETTER E WITH ACUTE"),
    ]


def test_variant_usage_fans_out_shared_letters(spark):
    counts = counts_of(spark, ہ=6, ھ=2, ه=2, ن=5)
    rows = sorted((r.group_id, r.rank, r.ch, r.n, r.pct_of_group) for r in ortho.variant_usage(counts).collect())
    assert rows == [
        (3, 1, "ہ", 6, 60.0), (3, 2, "ه", 2, 20.0), (3, 3, "ھ", 2, 20.0), (8, 1, "ہ", 6, 75.0), (8, 2, "ھ", 2, 25.0),
    ]


def test_learning(spark):
    groups = [["a", "á"], ["n", "ñ"]]

    def learned(**n):
        return {r.from_ch: r.to_ch for r in ortho.learn_char_map(counts_of(spark, **n), groups).collect()}

    assert learned(a=90, á=10, n=89, ñ=11) == {"á": "a"}
    assert learned(á=95, a=5) == {"a": "á"}
    assert learned(a=100) == {}
    assert learned(a=5, á=5) == {}
    tie = ortho.learn_char_map(counts_of(spark, á=5, a=5), groups, 0.5).collect()
    assert [(r.from_ch, r.to_ch) for r in tie] == [("á", "a")]


def test_merge_lets_the_new_map_win(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "from_ch string, to_ch string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "from_ch string, to_ch string")
    merged = {r.from_ch: r.to_ch for r in ortho.merge_char_map(old, new).collect()}
    assert merged == {"a": "1", "b": "3", "c": "4"}


def test_variants(spark):
    text = "كی ے" + "é"
    df = spark.createDataFrame([(1, text)], "ID long, kashmiri_text string")
    rows = {r.variant: r.kashmiri_text for r in ortho.expand_variants(df, "kashmiri_text").collect()}
    nfc = unicodedata.normalize("NFC", text)
    assert rows["baseline"] == nfc and len(rows) == 5
    for name, mapping in ortho.VARIANTS.items():
        assert rows[name] == "".join(mapping.get(c, c) for c in nfc)


def test_pure_maps_are_idempotent(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    once = ortho.normalize_column(docs, "text", ortho.VARIANTS["arabic"])
    twice = ortho.normalize_column(once, "text", ortho.VARIANTS["arabic"])
    assert once.exceptAll(twice).count() == 0
    assert once.filter(F.col("text").isNull()).count() == docs.filter(F.col("text").isNull()).count()
