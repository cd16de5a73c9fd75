"""Vocabulary from the corpus, and text to ids and back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators.ranking import with_rank
from pairloom.sources.options import option_table
from pairloom.sources.sinks import stage

BROADCAST_VOCAB = 1_000_000  # entries, counted; a larger vocabulary is joined by shuffle
FREQUENT = 1000  # entries of a larger vocabulary that are broadcast, so that no common piece is a hot key


def with_pieces(df: DataFrame, col: str, out: str = "pieces") -> DataFrame:
    return df.withColumn(out, T.tokenize(F.col(col)))


def build_vocab(
    df: DataFrame, pieces: str = "pieces", size: int = 32_000, specials: tuple[str, ...] = ("<s>", "<pad>", "</s>", "<unk>")
) -> DataFrame:
    """(piece, n, piece_id): the specials, then the ``size`` most frequent pieces, ties by code point.

    Counts are combined before the shuffle and staged. Classes of counts, a thousand at most, tell which pieces can be
    among the first ``size``; these are numbered by range (``with_rank``), so no task sorts them all.
    """
    # the outer form: for the inner one Spark adds a filter that would tokenise every text once more
    exploded = df.select(F.explode_outer(pieces).alias("piece")).filter(F.col("piece").isNotNull())
    counts = exploded.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.filter(~F.col("piece").isin(*specials)))
    level = F.floor(F.log2("n") * 16).cast("int")
    held = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, total = 0, 0
    for at in sorted(held, reverse=True):
        least, total = at, total + held[at]
        if total >= size:
            break
    ranked = with_rank(counts.filter(level >= least), F.desc("n"), F.asc("piece"), out="piece_id")
    top = ranked.filter(F.col("piece_id") <= size)
    numbered = top.withColumn("piece_id", (F.col("piece_id") + len(specials) - 1).cast("long"))
    reserved = option_table(
        df.sparkSession,
        piece=pa.array(specials, pa.string()),
        n=pa.array([0] * len(specials), pa.int64()),
        piece_id=pa.array(range(len(specials)), pa.int64()),
    )
    return reserved.unionByName(numbered)


def _lookup(df: DataFrame, vocab: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` by ``key`` for rows with a unique (_row, pos). A vocabulary of at most BROADCAST_VOCAB counted entries is
    broadcast. Of a larger one only the most frequent are; the rest meets the rows left by shuffle, where rows that are
    already served have keys of their own."""
    if vocab.limit(BROADCAST_VOCAB + 1).count() <= BROADCAST_VOCAB:
        return df.join(F.broadcast(vocab.select(key, value)), key, "left")
    order = F.desc("n") if "n" in vocab.columns else F.asc("piece_id")
    top = vocab.orderBy(order, "piece_id").limit(FREQUENT).select(key, F.col(value).alias("_top"))
    served = df.join(F.broadcast(top), key, "left")
    own = F.concat_ws("\0", F.lit(""), "_row", "pos")
    served = served.withColumn("_key", F.when(F.col("_top").isNull(), F.col(key).cast("string")).otherwise(own))
    rest = vocab.select(F.col(key).cast("string").alias("_key"), F.col(value).alias("_rest"))
    return served.join(rest, "_key", "left").withColumn(value, F.coalesce("_top", "_rest")).drop("_key", "_top", "_rest")


def _placed(df: DataFrame, id_col: str) -> DataFrame:
    """The short rows, each with a number, hashed by id ahead of exploding: the grouping then stays in place, and rows
    that share an id stay apart."""
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(id_col)


def _by_position(value: Column) -> Column:
    """Collected (pos, value) back in order; rows without elements give an empty array."""
    kept = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", value.alias("v"))))
    return F.transform(F.sort_array(kept), lambda x: x["v"])


def encode(
    df: DataFrame, vocab: DataFrame, id_col: str, pieces: str, out: str, limit: int, unk: int
) -> DataFrame:
    """(id, out): ids of the first ``limit`` pieces, unknown ones as ``unk``.

    Rows are cut to ``limit`` and hashed by id before they are exploded, so with a broadcast vocabulary the
    only shuffle carries the cut rows and groups stay within ``limit`` elements. Every input row gives one row, also
    where ids repeat.
    """
    placed = _placed(df.select(id_col, F.slice(pieces, 1, limit).alias("_p")), id_col)
    exploded = placed.select(id_col, "_row", F.posexplode_outer("_p").alias("pos", "piece"))
    found = _lookup(exploded, vocab, "piece", "piece_id")
    value = F.coalesce("piece_id", F.lit(unk))
    return found.groupBy(id_col, "_row").agg(_by_position(value).alias(out)).drop("_row")


def encode_labels(
    df: DataFrame,
    vocab: DataFrame,
    id_col: str = "id",
    pieces: str = "pieces",
    max_len: int = 128,
    unk: int = 3,
    eos: int = 2,
) -> DataFrame:
    """(id, labels): at most ``max_len - 1`` piece ids, then ``eos``."""
    ids = encode(df, vocab, id_col, pieces, "labels", max_len - 1, unk)
    return ids.withColumn("labels", F.array_append("labels", F.lit(eos).cast("long")))


def encode_inputs(
    df: DataFrame,
    vocab: DataFrame,
    id_col: str = "id",
    pieces: str = "pieces",
    max_len: int = 128,
    unk: int = 3,
    eos: int = 2,
) -> DataFrame:
    """(id, input_ids, attention_mask): at most ``max_len`` ids with the closing ``eos``; the mask is all ones."""
    ids = encode_labels(df, vocab, id_col, pieces, max_len, unk, eos).withColumnRenamed("labels", "input_ids")
    return ids.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def decode_labels(
    df: DataFrame,
    vocab: DataFrame,
    id_col: str = "id",
    labels: str = "labels",
    pad: int = 1,
    special: tuple[int, ...] = (0, 1, 2, 3),
) -> DataFrame:
    """(id, text): -100 read as ``pad``, special ids left out, pieces joined by a space; ids that the vocabulary
    lacks have no piece and are left out too."""
    real = F.transform(F.col(labels), lambda x: F.when(x == -100, F.lit(pad)).otherwise(x))
    kept = F.filter(real, lambda x: ~x.isin(*special))
    placed = _placed(df.select(id_col, kept.alias("_i")), id_col)
    exploded = placed.select(id_col, "_row", F.posexplode_outer("_i").alias("pos", "piece_id"))
    found = _lookup(exploded, vocab, "piece_id", "piece")
    return found.groupBy(id_col, "_row").agg(F.array_join(_by_position(F.col("piece")), " ").alias("text")).drop("_row")
