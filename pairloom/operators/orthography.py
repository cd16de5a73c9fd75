"""Character counts, spelling-variant groups, learned character maps, named variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.functions import text as T
from pairloom.sources.options import option_table

# --- fixed values -----------------------------------------------------------------------------
# Letters that stand for each other, most usual first: for learning a map and for auditing output.
LEARN_GROUPS = [
    ["ی", "ے", "ي", "ې", "ێ"],
    ["و", "ۄ", "ۆ", "ۏ"],
    ["ه", "ھ", "ۂ", "ة"],
    ["ن", "ں"],
    ["ا", "آ", "أ", "إ"],
]
AUDIT_GROUPS = [
    ["ی", "ے", "ي", "ې", "ێ", "ؠ"],
    ["و", "ۄ", "ۆ", "ۏ"],
    ["ه", "ھ", "ۂ", "ة", "ہ"],
    ["ن", "ں"],
    ["ا", "آ", "أ", "إ", "ٲ"],
    ["ك", "ک", "ڪ"],
    ["ٗ", "ٚ", "ٰ"],
    ["ہ", "ھ"],
]
DOMINANCE = 0.90
# Named spelling variants: letter -> letter to write instead.
VARIANTS = {
    "kashmiri": {
        "ے": "ی", "ي": "ی", "ې": "ی", "ێ": "ی",
        "ۆ": "و", "ۏ": "و",
        "ھ": "ہ", "ۂ": "ہ", "ة": "ہ",
        "ں": "ن",
        "أ": "ا", "إ": "ا",
        "ك": "ک", "ڪ": "ک",
    },
    "arabic": {
        "ی": "ي", "ے": "ي", "ې": "ي", "ێ": "ي",
        "ۄ": "و", "ۆ": "و", "ۏ": "و",
        "ھ": "ه", "ۂ": "ه", "ة": "ه", "ہ": "ه",
        "ں": "ن",
        "آ": "ا", "أ": "ا", "إ": "ا", "ٲ": "ا",
        "ک": "ك", "ڪ": "ك",
    },
    "perso": {
        "ے": "ی", "ي": "ی", "ې": "ی", "ێ": "ی",
        "ۄ": "و", "ۆ": "و", "ۏ": "و",
        "ۂ": "ھ",
        "ة": "ه",
        "ہ": "ھ",
        "ں": "ن",
        "آ": "ا", "أ": "ا", "إ": "ا", "ٲ": "ا",
        "ك": "ک", "ڪ": "ک",
    },
    "arabic_with_kvowels": {
        "ی": "ي", "ے": "ي", "ې": "ي", "ێ": "ي",
        "ۆ": "و", "ۏ": "و",
        "ھ": "ه", "ۂ": "ه", "ة": "ه", "ہ": "ه",
        "ں": "ن",
        "أ": "ا", "إ": "ا",
        "ک": "ك", "ڪ": "ك",
    },
}
# ----------------------------------------------------------------------------------------------


def char_counts(df: DataFrame, col: str, already_nfc: bool = False) -> DataFrame:
    """(ch, n, pct) over the NFC text. Tasks ship one row per distinct character, not per character.

    The percentage needs the grand total: a window over the counts, which are alphabet-sized.
    """
    text = F.col(col) if already_nfc else T.nfc(F.col(col))
    chars = df.select(F.explode_outer(F.split(text, "")).alias("ch")).filter(F.col("ch") != "")
    counts = chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return counts.select("ch", "n", (100.0 * F.col("n") / total).alias("pct"))


def top_chars(counts: DataFrame, k: int = 50, names: bool = False) -> DataFrame:
    """The ``k`` most frequent characters with their code points, ties by code point."""
    out = counts.orderBy(F.desc("n"), "ch").limit(k).withColumn("label", T.codepoint_label(F.col("ch")))
    return out.withColumn("name", T.char_name(F.col("ch"))) if names else out


def group_table(spark: SparkSession, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Variant groups as rows (group_id, ch, ord). As long as the option that was passed in."""
    rows = [
        (group_id, ch, ord_)
        for group_id, group in enumerate(groups, start=1)
        for ord_, ch in enumerate(dict.fromkeys(group))
    ]
    return option_table(
        spark,
        group_id=pa.array([r[0] for r in rows], pa.int32()),
        ch=pa.array([r[1] for r in rows], pa.string()),
        ord=pa.array([r[2] for r in rows], pa.int32()),
    )


def _present(counts: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    table = group_table(counts.sparkSession, groups)
    total = F.sum("n").over(W.partitionBy("group_id"))
    return counts.join(F.broadcast(table), "ch").select("group_id", "ch", "ord", "n", total.alias("group_total"))


def variant_usage(counts: DataFrame, groups: Sequence[Sequence[str]] = tuple(AUDIT_GROUPS)) -> DataFrame:
    """Share and rank of every variant in groups of which at least two variants occur."""
    group = W.partitionBy("group_id")
    ranked = _present(counts, groups).select(
        "group_id",
        "ch",
        "n",
        (100.0 * F.col("n") / F.col("group_total")).alias("pct_of_group"),
        F.row_number().over(group.orderBy(F.desc("n"), "ord")).alias("rank"),
        F.count(F.lit(1)).over(group).alias("_variants"),
    )
    return ranked.filter(F.col("_variants") >= 2).drop("_variants")


def learn_char_map(
    counts: DataFrame, groups: Sequence[Sequence[str]] = tuple(LEARN_GROUPS), threshold: float = DOMINANCE
) -> DataFrame:
    """(from_ch, to_ch): variants give way to their group's most frequent one if it has ``threshold`` of the group."""
    main = F.max_by(F.struct("ch", "n"), F.struct(F.col("n"), -F.col("ord"))).over(W.partitionBy("group_id"))
    candidates = _present(counts, groups).withColumn("main", main)
    kept = candidates.filter(
        (F.col("ch") != F.col("main.ch")) & (F.col("main.n") / F.col("group_total") >= threshold)
    )
    # a character in several groups follows the last of them
    pairs = kept.select(T.nfc(F.col("ch")).alias("from_ch"), T.nfc(F.col("main.ch")).alias("to_ch"), "group_id")
    return pairs.groupBy("from_ch").agg(F.max_by("to_ch", "group_id").alias("to_ch"))


def merge_char_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two maps; the new one wins where both have a key."""
    joined = old.withColumnRenamed("to_ch", "_old").join(new.withColumnRenamed("to_ch", "_new"), "from_ch", "full")
    return joined.select("from_ch", F.coalesce("_new", "_old").alias("to_ch"))


def normalize_column(
    df: DataFrame, col: str, char_map: Mapping[str, str] | None = None, suffixes=None, renormalize: bool = True
) -> DataFrame:
    return df.withColumn(col, T.normalize_text(F.col(col), char_map, suffixes, renormalize))


def expand_variants(
    df: DataFrame, col: str, variants: Mapping[str, Mapping[str, str]] = VARIANTS, baseline: bool = True
) -> DataFrame:
    """Every row once per variant, in one narrow pass. NFC runs once; maps are not followed by another NFC."""
    text = F.col("_nfc")
    versions: list[Column] = [F.struct(F.lit("baseline").alias("variant"), text.alias("text"))] if baseline else []
    versions += [
        F.struct(F.lit(name).alias("variant"), T.apply_char_map(text, char_map).alias("text"))
        for name, char_map in variants.items()
    ]
    out = df.withColumn("_nfc", T.nfc(F.col(col))).withColumn("_v", F.explode(F.array(*versions)))
    return out.withColumns({"variant": F.col("_v.variant"), col: F.col("_v.text")}).drop("_nfc", "_v")
