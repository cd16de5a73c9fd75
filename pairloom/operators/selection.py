"""Candidate pools and consensus choice (minimum Bayes risk)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairloom.functions import text as T
from pairloom.functions.overlap import BOUND_SUMS, asked_sums, bound_sums, tile_sums
from pairloom.sources.sinks import stage

BLOCK = 64  # candidates per block; an id with more is cut into a grid of block pairs
BLOCK_BYTES = 1 << 18  # of text per block, and one text more
RUN = 64  # blocks that are numbered together, in one group of a window
HOT_IDS = 1000  # ids whose sizes are broadcast; any other has under a thousandth of the text


def regroup_flat(df: DataFrame, pos: str, n_best: int) -> DataFrame:
    """A flat candidate list by position into sentences: add ``id`` and ``rank``."""
    return df.withColumns(
        {"id": F.floor(F.col(pos) / n_best).cast("long"), "rank": F.pmod(F.col(pos), F.lit(n_best)).cast("int")}
    )


def latest_models(cands: DataFrame, k: int) -> DataFrame:
    """Candidates of the ``k`` models with the highest step (0: all)."""
    if not k:
        return cands
    latest = cands.groupBy("model").agg(F.max("model_step").alias("_step")).orderBy(F.desc("_step"), "model").limit(k)
    return cands.join(F.broadcast(latest.select("model")), "model", "left_semi")


def candidate_pool(*parts: DataFrame, priority: tuple[int, ...] | None = None) -> DataFrame:
    """Candidates (id, model, rank, text) of several models as one pool with a pool position.

    ``pos`` orders by model, then rank. ``priority`` gives the model order (lower is earlier); as repeats of
    a candidate are dropped before choosing, a preferred model can only win ties by coming first.
    """
    priority = priority or tuple(range(len(parts)))
    tagged = [
        p.withColumn("pos", (F.lit(order).cast("long") * F.lit(1 << 32)) + F.col("rank").cast("long"))
        for order, p in zip(priority, parts)
    ]
    pool = tagged[0]
    for part in tagged[1:]:
        pool = pool.unionByName(part)
    return pool


def candidate_dedup(cands: DataFrame, weight: str | None = None) -> DataFrame:
    """Distinct texts per id with their earliest position, and with ``weight`` the summed weight of their repeats. Rows
    without an id belong to no sentence; a null weight counts 0."""
    merged = [F.min("pos").cast("long").alias("pos")]
    if weight:
        merged.append(F.coalesce(F.sum(F.col(weight).cast("double")), F.lit(0.0)).alias("weight"))
    return cands.filter(F.col("id").isNotNull()).groupBy("id", "text").agg(*merged)


def _sized(distinct: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """``distinct`` with ``runs``: null for an id that fits one block, else into how many groups of about RUN blocks its
    candidates are dealt. The sizes of the ids with most text are broadcast; of the others none is a hot key."""
    text_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # counting ``pos`` keeps this plan equal to the other use of ``distinct``, so Spark shuffles that once
    sizes = distinct.groupBy("id").agg(F.count("pos").alias("n"), F.sum(text_bytes).alias("bytes"))
    sizes = sizes.filter((F.col("n") > block) | (F.col("bytes") > block_bytes))
    runs = F.floor(F.col("n") / (RUN * block)) + F.floor(F.col("bytes") / (RUN * block_bytes)) + 1
    hot = sizes.orderBy(F.desc("bytes"), "id").limit(HOT_IDS).select("id", runs.alias("runs"))
    met = distinct.join(F.broadcast(hot), "id", "left")
    rest = met.filter(F.col("runs").isNull()).drop("runs").join(sizes.select("id", runs.alias("runs")), "id", "left")
    return met.filter(F.col("runs").isNotNull()).unionByName(rest)


def _grid(sized: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Candidates of large ids on tiles (id, i, j) such that every pair of an id meets on one tile. Running counts and
    bytes inside a run decide the blocks: at most ``block`` candidates, and ``block_bytes`` and one text."""
    dealt = sized.withColumn("_run", F.pmod("key", F.col("runs")))
    before = W.partitionBy("id", "_run").orderBy("key", "pos").rowsBetween(W.unboundedPreceding, -1)
    rows = F.count("pos").over(before)
    text_bytes = F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(before), F.lit(0))
    # both only grow, so rows with one sum have both alike
    at = F.floor(rows / F.lit(block)) + F.floor(text_bytes / F.lit(block_bytes))
    blocks = dealt.withColumn("_at", at)
    number = F.dense_rank().over(W.partitionBy("id", "_run").orderBy("_at")) - 1
    blocks = blocks.withColumn("_block", number)
    counts = blocks.groupBy("id", "_run").agg((F.max("_block") + 1).alias("_n"))
    every, earlier = W.partitionBy("id"), W.partitionBy("id").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        "id", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"), F.sum("_n").over(every).alias("_all")
    )
    own = blocks.join(counts, ["id", "_run"]).withColumn("_own", (F.col("_first") + F.col("_block")).cast("long"))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1)).alias("_other")
    return own.select("*", meets).select(
        "id", "pos", "text", "key", "weight", "asked",
        F.least("_own", "_other").alias("i"),
        F.greatest("_own", "_other").alias("j"),
        (F.col("_own") > F.col("_other")).alias("second"),
    )


def _tiles(distinct: DataFrame, block: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Candidates on tiles: of ids that fit one block, and of larger ones. ``key`` tells apart what shares a position."""
    if "weight" not in distinct.columns:
        distinct = distinct.withColumn("weight", F.lit(1.0))
    if "asked" not in distinct.columns:
        distinct = distinct.withColumn("asked", F.lit(True))
    sized = _sized(distinct.withColumn("key", F.xxhash64("text")), block, block_bytes)
    zero = F.lit(0).cast("long")
    small = sized.filter(F.col("runs").isNull()).select(
        "id", "pos", "text", "key", "weight", "asked", zero.alias("i"), zero.alias("j"), F.lit(False).alias("second")
    )
    return small, _grid(sized.filter(F.col("runs").isNotNull()), block, block_bytes)


def _prepared(tiles: DataFrame, partitions: int, text: Column) -> DataFrame:
    """Tiles in order, one after another, with the forms of each text, which are made behind the shuffle."""
    placed = tiles.repartition(partitions, "id", "i", "j").sortWithinPartitions("id", "i", "j")
    return placed.select(
        "id", "pos", "key", text.alias("text"), "i", "j", "second", "weight", "asked",
        T.drop_whitespace(F.col("text")).alias("chars"),
        T.chrf_words(F.col("text")).alias("words"),
        T.bleu_tokens(F.col("text")).alias("tokens"),
    )


def _scored(tiles: DataFrame, partitions: int, with_text: bool) -> DataFrame:
    """Sums of every candidate over the partners on its tile. Tiles stream through the Arrow function in order, so that
    it holds a few of them at a time."""
    prepared = _prepared(tiles, partitions, F.col("text") if with_text else F.lit(None).cast("string"))
    schema = StructType(prepared.select("id", "pos", "key", "text").schema.fields).add("partners", "long")
    for name in ("weight", "chrf", "bleu"):
        schema = schema.add(name, "double")
    return prepared.mapInArrow(tile_sums, schema)


def _mean(score: str) -> Column:
    return F.when(F.col("weight") > 0, F.col(score) / F.col("weight")).otherwise(0.0)


def _utility(metric: str) -> Column:
    return {"chrf": F.col("chrf"), "bleu": F.col("bleu"), "geo": F.sqrt(F.col("chrf") * F.col("bleu"))}[metric]


def mbr_utilities(
    cands: DataFrame,
    metric: str = "geo",
    block: int = BLOCK,
    partitions: int | None = None,
    weight: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, pos, text, partners, chrf, bleu, utility): mean sentence score of every distinct candidate.

    Each candidate is scored against all other distinct candidates of its id, exactly. Pairs never become
    rows: a tile counts each pair once, scores it both ways and emits one partial sum per candidate. Text is on the
    tiles alone; sums of large ids go by position and key and meet their text at the end.

    With ``weight``, the mean over partners is weighted by that column, repeats of a candidate adding up. A candidate's
    own weight and repeats never count for itself. Without weight among the partners the scores are 0.
    """
    partitions = partitions or int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = candidate_dedup(cands, weight)
    small, large = _tiles(distinct, block, block_bytes)
    summed = _scored(large, partitions, with_text=False).groupBy("id", "pos", "key").agg(
        *[F.sum(c).alias(c) for c in ("partners", "weight", "chrf", "bleu")]
    )
    texts = distinct.select("id", "pos", F.xxhash64("text").alias("key"), "text")
    every = _scored(small, partitions, with_text=True).unionByName(summed.join(texts, ["id", "pos", "key"]))

    means = every.withColumns({c: _mean(c) for c in ("chrf", "bleu")}).drop("key", "weight")
    return means.withColumn("utility", _utility(metric))


def mbr_bounds(distinct: DataFrame, metric: str, block: int, partitions: int, block_bytes: int) -> DataFrame:
    """(id, pos, key, partners, upper): for every distinct candidate a bound that its utility does not exceed.

    How much a candidate shares with all its partners together follows from counts of n-grams, at a cost that goes with
    the text and not with pairs. Sentence chrF is a concave function of precision and recall, and BLEU's geometric mean
    is one of the precisions, so the score of the means is at least the mean of the scores. Shorter texts are not
    penalised here, and an order without a match counts as half a match, its largest value after smoothing.
    """
    small, large = _tiles(distinct, block, block_bytes)
    prepared = _prepared(small.unionByName(large), partitions, F.lit(None).cast("string"))
    schema = StructType(prepared.select("id", "pos", "key").schema.fields)
    for name in BOUND_SUMS:
        schema = schema.add(name, "double")
    sums = prepared.mapInArrow(bound_sums, schema.add("n_tokens", "long")).groupBy("id", "pos", "key")
    summed = sums.agg(*[F.sum(c).alias(c) for c in BOUND_SUMS], F.max("n_tokens").alias("n_tokens"))
    precision, recall = (F.least(_mean(c), F.lit(1.0)) for c in ("precision", "recall"))
    chrf = F.when(precision + recall > 0, 500 * precision * recall / (4 * precision + recall)).otherwise(0.0)
    bleu = F.lit(100.0)
    for k in range(1, 5):
        total = F.greatest(F.col("n_tokens") - (k - 1), F.lit(0))
        share = F.when(total > 0, F.least((_mean(f"b{k}") + 0.5) / total, F.lit(1.0))).otherwise(0.0)
        bleu = bleu * F.sqrt(F.sqrt(share))
    return summed.select("id", "pos", "key", "partners", chrf.alias("chrf"), bleu.alias("bleu")).select(
        "id", "pos", "key", F.col("partners").cast("long").alias("partners"), _utility(metric).alias("upper")
    )


def mbr_choose(
    cands: DataFrame,
    metric: str = "geo",
    block: int = BLOCK,
    partitions: int | None = None,
    weight: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, pos, text, utility, pairs, scored): the choice of ``mbr_select`` without scoring every pair.

    Branch and bound: of each id the candidate with the highest bound (``mbr_bounds``) is scored against all its
    partners, then those whose bound its utility does not beat. Tiles without such a candidate are left out. ``pairs``
    counts the ordered pairs of the id, ``scored`` those that were scored. Runs jobs that stage candidates and bounds;
    for pools of a few candidates ``mbr_utilities`` is cheaper.
    """
    partitions = partitions or int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = stage(candidate_dedup(cands, weight).withColumn("key", F.xxhash64("text")))
    if not weight:
        distinct = distinct.withColumn("weight", F.lit(1.0))
    bounded = stage(mbr_bounds(distinct, metric, block, partitions, block_bytes))

    def exact(asked: DataFrame) -> DataFrame:
        """Utilities of the candidates in ``asked`` (id, pos, key)."""
        wanted = asked.select("id", "pos", "key", F.lit(True).alias("asked"))
        marked = distinct.join(wanted, ["id", "pos", "key"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        marked = marked.join(asked.select("id").distinct(), "id", "left_semi")
        small, large = _tiles(marked, block, block_bytes)
        tiles = small.unionByName(large)
        tiles = tiles.join(tiles.filter("asked").select("id", "i", "j").distinct(), ["id", "i", "j"], "left_semi")
        prepared = _prepared(tiles, partitions, F.lit(None).cast("string"))
        schema = StructType(prepared.select("id", "pos", "key").schema.fields)
        names = ("partners", "weight", "chrf", "bleu")
        for name in names:
            schema = schema.add(name, "double")
        summed = prepared.mapInArrow(asked_sums, schema).groupBy("id", "pos", "key").agg(*[F.sum(c).alias(c) for c in names])
        means = summed.withColumns({c: _mean(c) for c in ("chrf", "bleu")})
        return means.select("id", "pos", "key", F.col("partners").cast("long").alias("scored"), _utility(metric).alias("utility"))

    first = F.max(F.struct("upper", (-F.col("pos")).alias("neg"), "key", "partners")).alias("b")
    leaders = bounded.groupBy("id").agg(first).select("id", (-F.col("b.neg")).alias("pos"), F.col("b.key").alias("key"))
    led = stage(exact(leaders))
    beaten = led.select("id", F.col("pos").alias("first_pos"), F.col("key").alias("first_key"), F.col("utility").alias("least"))
    open_ = bounded.join(beaten, "id").filter(F.col("upper") >= F.col("least") - 1e-6)  # bounds are rounded too
    open_ = open_.filter((F.col("pos") != F.col("first_pos")) | (F.col("key") != F.col("first_key")))
    known = led.unionByName(exact(open_))
    best = F.max(F.struct(F.round("utility", 9).alias("utility"), (-F.col("pos")).alias("neg"), "key")).alias("b")
    chosen = known.groupBy("id").agg(best, F.sum("scored").alias("scored"))
    chosen = chosen.select("id", (-F.col("b.neg")).alias("pos"), F.col("b.key").alias("key"), "b.utility", "scored")
    pairs = bounded.groupBy("id").agg(F.sum("partners").alias("pairs"))
    texts = distinct.select("id", "pos", "key", "text")
    whole = chosen.join(texts, ["id", "pos", "key"]).join(pairs, "id")
    return whole.select("id", "pos", "text", "utility", "pairs", "scored")


def mbr_select(utilities: DataFrame) -> DataFrame:
    """(id, pos, text, utility) of the best candidate per id; equal to nine digits, the earliest wins."""
    best = F.max(F.struct(F.round("utility", 9).alias("utility"), (-F.col("pos")).alias("neg"), "text")).alias("b")
    chosen = utilities.groupBy("id").agg(best)
    return chosen.select("id", (-F.col("b.neg")).alias("pos"), "b.text", "b.utility")
