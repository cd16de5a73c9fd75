"""Translation scores. Every score is a closed form over sums, so one pass over the pairs is enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import scores
from pairloom.functions import text as T
from pairloom.functions.overlap import overlap

CHAR_ORDER, WORD_ORDER, BLEU_ORDER = 6, 2, 4
CHRF_ORDERS = CHAR_ORDER + WORD_ORDER


def _totals(length: Column, orders: int) -> list[Column]:
    return [F.greatest(length - n, F.lit(0)).cast("long") for n in range(orders)]


def chrf_vectors(df: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Add ``chrf_hyp``, ``chrf_ref``, ``chrf_shared``: n-gram counts for character orders 1-6, word orders 1-2."""
    h, r = F.coalesce(F.col(hyp), F.lit("")), F.coalesce(F.col(ref), F.lit(""))
    prepared = df.withColumns(
        {"_hc": T.drop_whitespace(h), "_rc": T.drop_whitespace(r), "_hw": T.chrf_words(h), "_rw": T.chrf_words(r)}
    )
    h_all = _totals(F.length("_hc"), CHAR_ORDER) + _totals(F.size("_hw"), WORD_ORDER)
    r_all = _totals(F.length("_rc"), CHAR_ORDER) + _totals(F.size("_rw"), WORD_ORDER)
    shared = F.concat(overlap(F.col("_hc"), F.col("_rc"), CHAR_ORDER), overlap(F.col("_hw"), F.col("_rw"), WORD_ORDER))
    counted = prepared.withColumns(
        {
            "chrf_hyp": F.array(*[F.when(b > 0, a).otherwise(F.lit(0)) for a, b in zip(h_all, r_all)]),
            "chrf_ref": F.array(*r_all),
            "chrf_shared": shared,
        }
    )
    return counted.drop("_hc", "_rc", "_hw", "_rw")


def bleu_vectors(df: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Add ``bleu_correct``, ``bleu_total`` (orders 1-4), ``sys_len``, ``ref_len``."""
    prepared = df.withColumns({"_hb": T.bleu_tokens(F.coalesce(F.col(hyp), F.lit(""))),
                               "_rb": T.bleu_tokens(F.coalesce(F.col(ref), F.lit("")))})
    counted = prepared.withColumns(
        {
            "bleu_correct": overlap(F.col("_hb"), F.col("_rb"), BLEU_ORDER),
            "bleu_total": F.array(*_totals(F.size("_hb"), BLEU_ORDER)),
            "sys_len": F.size("_hb").cast("long"),
            "ref_len": F.size("_rb").cast("long"),
        }
    )
    return counted.drop("_hb", "_rb")


def token_vectors(df: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Add ``hyp_tokens``, ``ref_tokens``, ``common``: token counts and the shared tokens with repeats."""
    prepared = df.withColumns({"_ht": T.tokenize(F.coalesce(F.col(hyp), F.lit(""))),
                               "_rt": T.tokenize(F.coalesce(F.col(ref), F.lit("")))})
    counted = prepared.withColumns(
        {
            "hyp_tokens": F.size("_ht").cast("long"),
            "ref_tokens": F.size("_rt").cast("long"),
            "common": overlap(F.col("_ht"), F.col("_rt"), 1)[0],
        }
    )
    return counted.drop("_ht", "_rt")


def _items(column: str, n: int) -> list[Column]:
    return [F.col(column)[i] for i in range(n)]


def _sums(column: str, n: int) -> list[Column]:
    return [F.sum(F.col(column)[i]) for i in range(n)]


def with_sentence_scores(df: DataFrame) -> DataFrame:
    """Add ``chrf`` and ``bleu`` of each pair from its own counts."""
    chrf = scores.chrf(*[_items(c, CHRF_ORDERS) for c in ("chrf_hyp", "chrf_ref", "chrf_shared")])
    bleu = scores.bleu(
        _items("bleu_correct", BLEU_ORDER), _items("bleu_total", BLEU_ORDER), F.col("sys_len"), F.col("ref_len")
    )
    return df.withColumns({"chrf": chrf, "bleu": bleu})


def _from_sums(n: int, names: tuple[str, ...]) -> list[list[Column]]:
    return [[F.col(f"{name}_{i}") for i in range(n)] for name in names]


CHRF_NAMES = ("chrf_hyp", "chrf_ref", "chrf_shared")
BLEU_NAMES = ("bleu_correct", "bleu_total")


def _chrf_sums() -> list[Column]:
    return [s.alias(f"{c}_{i}") for c in CHRF_NAMES for i, s in enumerate(_sums(c, CHRF_ORDERS))]


def _bleu_sums() -> list[Column]:
    sums = [s.alias(f"{c}_{i}") for c in BLEU_NAMES for i, s in enumerate(_sums(c, BLEU_ORDER))]
    return [*sums, F.sum("sys_len").alias("sys_len"), F.sum("ref_len").alias("ref_len")]


def _chrf_of_sums() -> Column:
    return scores.chrf(*_from_sums(CHRF_ORDERS, CHRF_NAMES))


def _bleu_of_sums() -> Column:
    return scores.bleu(*_from_sums(BLEU_ORDER, BLEU_NAMES), F.col("sys_len"), F.col("ref_len"))


def chrf_corpus(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by: tuple[str, ...] = ()) -> DataFrame:
    """chrF++ of all pairs together (or per ``by`` group): sum the counts, then score once."""
    summed = chrf_vectors(df.select(*by, hyp, ref), hyp, ref).groupBy(*by).agg(*_chrf_sums())
    return summed.select(*by, _chrf_of_sums().alias("chrf"))


def bleu_corpus(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by: tuple[str, ...] = ()) -> DataFrame:
    summed = bleu_vectors(df.select(*by, hyp, ref), hyp, ref).groupBy(*by).agg(*_bleu_sums())
    return summed.select(*by, _bleu_of_sums().alias("bleu"))


def exact_match(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(_exact(hyp, ref).alias("accuracy"))


def _exact(hyp: str, ref: str) -> Column:
    """A missing side is an empty text, as in all metrics."""
    return F.avg((_text(hyp) == _text(ref)).cast("double"))


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _prf() -> dict[str, Column]:
    """Token precision, recall, F1; an empty side scores 0."""
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("common", "hyp_tokens"), zero)
    recall = F.coalesce(F.try_divide("common", "ref_tokens"), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)
    return {"precision": precision, "recall": recall, "f1": f1}


def token_prf(df: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Add token counts and precision, recall and F1 of each pair."""
    return token_vectors(df, hyp, ref).withColumns(_prf())


def token_prf_macro(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over pairs of precision, recall and F1."""
    each = token_prf(df.select(*by, hyp, ref), hyp, ref)
    return each.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def _length_aggregates() -> list[Column]:
    h, r = F.col("hyp_tokens").cast("double"), F.col("ref_tokens").cast("double")
    square = F.pow(h - r, F.lit(2.0))
    zero = F.lit(0.0)
    pearson = F.try_divide(F.covar_pop(h, r), F.stddev_pop(h) * F.stddev_pop(r))
    spread = F.var_pop(r) * F.count(r)
    return [
        F.sqrt(F.avg(square)).alias("rmse"),
        F.when(F.count(r) > 0, F.coalesce(pearson, zero)).alias("pearson"),
        F.when(F.count(r) > 0, F.coalesce(1 - F.try_divide(F.sum(square), spread), zero)).alias("r2"),
    ]


def length_stats(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by: tuple[str, ...] = ()) -> DataFrame:
    """Token-count RMSE, Pearson correlation and R² (1 - SSres/SStot) of predictions against references."""
    counted = df.select(
        *by, F.size(T.tokenize(_text(hyp))).alias("hyp_tokens"), F.size(T.tokenize(_text(ref))).alias("ref_tokens")
    )
    return counted.groupBy(*by).agg(*_length_aggregates())


def corpus_report(df: DataFrame, hyp: str = "hyp", ref: str = "ref", by: tuple[str, ...] = ()) -> DataFrame:
    """All ten metrics in one pass, unrounded, scores in 0..100. No pairs: nulls."""
    pairs = df.select(*by, hyp, ref)
    each = token_vectors(bleu_vectors(chrf_vectors(pairs, hyp, ref), hyp, ref), hyp, ref).withColumns(_prf())
    summed = each.groupBy(*by).agg(
        *_chrf_sums(),
        *_bleu_sums(),
        _exact(hyp, ref).alias("accuracy"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        *_length_aggregates(),
    )
    scored = summed.withColumns({"chrf": _chrf_of_sums(), "bleu": _bleu_of_sums()})
    percent = [(100 * F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    return scored.select(
        *by, "chrf", "bleu", F.sqrt(F.col("chrf") * F.col("bleu")).alias("geo_mean"), *percent, "rmse", "pearson", "r2"
    )


def display(report: DataFrame) -> DataFrame:
    """The report as printed: two digits, three for the correlations."""
    digits = {"pearson": 3, "r2": 3}
    numbers = [f.name for f in report.schema if f.dataType.typeName() == "double"]
    return report.withColumns({c: F.round(c, digits.get(c, 2)) for c in numbers})


def _with_grams(rows: DataFrame, seq: str, orders: int) -> tuple[DataFrame, list[Column]]:
    """Add the n-grams of every order, each from the order before it: an n-gram and the symbol behind it. A column an
    order, so that none is made twice."""
    found = [seq]
    for n in range(2, orders + 1):
        left = F.greatest(F.size(seq) - (n - 1), F.lit(0))
        longer = F.zip_with(F.slice(found[-1], 1, left), F.slice(seq, n, left), lambda g, s: F.concat_ws("\x1f", g, s))
        rows = rows.withColumn(f"_{seq}{n}", longer)
        found.append(f"_{seq}{n}")
    return rows, [F.col(name) for name in found]


def gram_table(df: DataFrame, id_col: str, hyp: str, ref: str, kind: str = "chrf") -> DataFrame:
    """N-grams as rows (id, side, ord, gram); chrF orders 1-6 are characters, 7-8 words; BLEU orders 1-4 tokens."""
    sides = F.array(
        F.struct(F.lit("h").alias("side"), F.col(hyp).alias("t")), F.struct(F.lit("r").alias("side"), F.col(ref).alias("t"))
    )
    rows = df.select(F.col(id_col), F.inline(sides))
    text = F.coalesce(F.col("t"), F.lit(""))
    if kind == "chrf":
        chars = F.filter(F.split(T.drop_whitespace(text), ""), lambda c: c != "")
        rows = rows.select(id_col, "side", chars.alias("c"), T.chrf_words(text).alias("w"))
        rows, chars_of = _with_grams(rows, "c", CHAR_ORDER)
        rows, words_of = _with_grams(rows, "w", WORD_ORDER)
        grams = chars_of + words_of
    else:
        rows = rows.select(id_col, "side", T.bleu_tokens(text).alias("b"))
        rows, grams = _with_grams(rows, "b", BLEU_ORDER)
    tagged = F.array(*[F.struct(F.lit(i).alias("ord"), g.alias("grams")) for i, g in enumerate(grams, start=1)])
    each = rows.select(id_col, "side", F.inline(tagged))
    return each.select(id_col, "side", "ord", F.explode_outer("grams").alias("gram")).filter(
        F.col("gram").isNotNull()
    )


def gram_counts(
    df: DataFrame, id_col: str = "id", hyp: str = "hyp", ref: str = "ref", kind: str = "chrf", partitions: int | None = None
) -> DataFrame:
    """(id, ord, h, r, m) from n-gram rows and grouping only: the form without Python, for cross-checks.

    The short rows are hashed by id first, so exploding and both groupings stay inside their tasks. An explicit count
    (``spark.sql.shuffle.partitions`` by default) keeps Spark from merging these light partitions ahead of the explode.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(id_col, hyp, ref).repartition(partitions, id_col)
    grams = gram_table(placed, id_col, hyp, ref, kind)
    is_hyp = (F.col("side") == "h").cast("long")
    each = grams.groupBy(id_col, "ord", "gram").agg(F.sum(is_hyp).alias("h"), F.sum(1 - is_hyp).alias("r"))
    return each.groupBy(id_col, "ord").agg(
        F.sum("h").alias("h"), F.sum("r").alias("r"), F.sum(F.least("h", "r")).alias("m")
    )
