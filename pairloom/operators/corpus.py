"""Cleaning, deduplication, script guards, splits and alignment."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, MapType, VariantType

from pairloom.functions import text as T
from pairloom.operators.ranking import order_statistic

DIGITS = 4  # hex digits of a hash that one histogram counts: 65,536 rows at most


def pick_column(df: DataFrame, wanted: str | None, fallback: str | int) -> str:
    """``wanted`` if present, else ``fallback`` by name if present, else by position (a missing name: last)."""
    if wanted in df.columns:
        return wanted
    if isinstance(fallback, int):
        return df.columns[fallback]
    return fallback if fallback in df.columns else df.columns[-1]


def clean_pairs(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Strip both sides and drop pairs with a missing or blank side."""
    stripped = df.withColumns({c: T.strip_text(F.col(c)) for c in (source, target)})
    return stripped.filter((F.col(source) != "") & (F.col(target) != ""))


def dedup_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Keep the first row of every key. Duplicates are reduced before the shuffle.

    The leading hash only makes the sort cheap (long keys share prefixes); equality is on the keys.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first")
    grouped = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(first)
    return grouped.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def script_counts(col: Column, char_class: str) -> tuple[Column, Column]:
    """Sums over all rows: characters in the class, and characters that are not whitespace."""
    return F.sum(T.count_class(col, char_class)), F.sum(F.length(T.drop_whitespace(col)).cast("long"))


def script_ratio(col: Column, char_class: str) -> Column:
    """Aggregate: share of the visible characters that lie in the class; 0 without any."""
    inside, visible = script_counts(col, char_class)
    return F.coalesce(F.try_divide(inside, visible), F.lit(0.0))


def head_n(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows, nulls first; ``n`` 0 keeps all. Of rows that tie at the end, the first by their other columns
    stay, as far as these can be ordered.

    Runs jobs over the ordering columns alone for the last key within (``order_statistic``), then filters; only rows with
    that key are sorted.
    """
    if not n:
        return df
    found = order_statistic(df, order_by, n)
    if found is None:
        return df
    last, ties = found
    kinds = [df.schema[c].dataType for c in order_by]
    bounds = [F.lit(v).cast(kind) for v, kind in zip(last, kinds, strict=True)]
    keys = [F.col(f"`{c}`") for c in order_by]
    same = reduce(lambda a, b: a & b, [k.eqNullSafe(v) for k, v in zip(keys, bounds, strict=True)])
    if len(keys) == 1 and last[0] is not None:
        before = keys[0].isNull() | (keys[0] < bounds[0])  # a plain comparison, which reaches the scan
    else:
        before = F.struct(*[k.alias(c) for k, c in zip(keys, order_by)]) < F.struct(
            *[v.alias(c) for v, c in zip(bounds, order_by)]
        )
    rest = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return df.filter(before).unionByName(df.filter(same).orderBy(*rest).limit(ties))


def check_scripts(
    df: DataFrame,
    source: str = "source",
    target: str = "target",
    order_by: tuple[str, ...] = ("pair_id",),
    n: int = 0,
    source_class: str = T.LATIN,
    target_class: str = T.ARABIC,
    source_min: float = 0.5,
    target_min: float = 0.2,
) -> DataFrame:
    """One row: script shares of all rows (of the first ``n``, if given) and whether they look like the right columns."""
    ratios = (head_n(df, list(order_by), n) if n else df).agg(
        script_ratio(F.col(source), source_class).alias("source_ratio"),
        script_ratio(F.col(target), target_class).alias("target_ratio"),
    )
    return ratios.withColumn("ok", (F.col("source_ratio") >= source_min) & (F.col("target_ratio") >= target_min))


def require_scripts(df: DataFrame, **options) -> None:
    row = check_scripts(df, **options).first()
    if not row.ok:
        raise ValueError(
            f"script check failed, columns may be swapped: source {row.source_ratio:.2f}, target {row.target_ratio:.2f}"
        )


def require_target_script(df: DataFrame, target: str = "target", order_by: tuple[str, ...] = ("pair_id",), n: int = 0) -> None:
    """The guard in front of encoding: narrower class, target only."""
    require_scripts(
        df, source=target, target=target, order_by=order_by, n=n, target_class=T.ARABIC_NARROW, source_min=0.0
    )


def seeded_hash(key: Column, seed: int) -> Column:
    """32 hex digits, the same for the same key and seed wherever the row lives. All null keys are one key."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\0")), F.lit(f"#{seed}")))


def hash_split(df: DataFrame, key: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``. A key always lands in the same split, so no key leaks and appended rows move nothing."""
    bucket = F.conv(F.substring(seeded_hash(F.col(key), seed), 1, 8), 16, 10).cast("long") % 1_000_000
    test_end, val_end = round(test * 1_000_000), round((test + val) * 1_000_000)
    split = F.when(bucket < test_end, "test").when(bucket < val_end, "val").otherwise("train")
    return df.withColumn("split", split)


def hash_cuts(df: DataFrame, hashed: Column, bounds) -> list[str]:
    """For every bound, the hash of the row at that place in hash order ("" for a bound of 0, "g", which is beyond all
    hashes, for a bound of all rows or more). ``bounds`` takes the number of rows and gives places.

    Runs jobs over the key column alone: a histogram of the leading hex digits, one of the next digits of the groups
    that a bound falls into, and the few hashes left there.
    """
    keys = df.select(hashed.alias("h"))

    def histogram(prefixes: set[str] | None, digits: int) -> dict[str, int]:
        inside = keys if prefixes is None else keys.filter(F.substring("h", 1, digits - DIGITS).isin(*prefixes))
        group = F.substring("h", 1, digits).alias("g")
        return {r.g: r.n for r in inside.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}

    counts = histogram(None, DIGITS)
    total = sum(counts.values())
    places = {i: (min(b, total), "") for i, b in enumerate(bounds(total))}
    cuts = {i: "" if b <= 0 else "g" for i, (b, _) in places.items() if b <= 0 or b >= total}
    places = {i: p for i, p in places.items() if i not in cuts}
    for digits in (DIGITS, 2 * DIGITS, 32):
        if not places:
            break
        if digits == 2 * DIGITS:
            counts = histogram({prefix for _, prefix in places.values()}, digits)
        elif digits == 32:
            left = keys.filter(F.substring("h", 1, 2 * DIGITS).isin(*{prefix for _, prefix in places.values()}))
            counts = {r.h: r.n for r in left.groupBy("h").agg(F.count(F.lit(1)).alias("n")).collect()}
        for i, (place, prefix) in places.items():
            for group in sorted(g for g in counts if g.startswith(prefix)):
                if place <= counts[group]:
                    places[i] = (place, group)
                    break
                place -= counts[group]
    return [cuts.get(i) or places.get(i, (0, ""))[1] for i in range(len(cuts) + len(places))]


def exact_split(df: DataFrame, key: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split`` with exact sizes: test is ceil(test n), val is ceil(val/(1-test) of what is left).

    The cut-off hashes come from jobs over the keys (``hash_cuts``); labelling is one pass that moves no row. A repeated
    key is always in one split, so sizes are exact for unique keys and else up to the repeats of the key at the cut.
    """

    def bounds(n: int) -> list[int]:
        n_test = math.ceil(float(test) * n)
        return [n_test, n_test + math.ceil(val / (1 - test) * (n - n_test))]

    hashed = seeded_hash(F.col(key), seed)
    test_end, val_end = hash_cuts(df, hashed, bounds)
    return df.withColumn("split", F.when(hashed <= test_end, "test").when(hashed <= val_end, "val").otherwise("train"))


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement (all rows when there are fewer), the same ones in any partitioning. A repeated key
    comes with all its rows, so there may be more by the repeats of the last key."""
    hashed = seeded_hash(F.col(key), seed)
    return df.filter(hashed <= hash_cuts(df, hashed, lambda n: [k])[0])


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_overlap(df: DataFrame, key: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One row: for each pair of splits, how many distinct keys are in both. One shuffle for all pairs, of digests: keys
    may be long texts."""
    seen = df.groupBy(F.sha2(F.col(key).cast("string"), 256)).agg(*[F.max(F.col("split") == s).alias(s) for s in splits])
    return seen.agg(
        *[
            F.coalesce(F.sum((F.col(a) & F.col(b)).cast("long")), F.lit(0)).alias(f"{a}_{b}")
            for a, b in combinations(splits, 2)
        ]
    )


def require_disjoint(df: DataFrame, key: str, splits: tuple[str, ...] = ("train", "val", "test")) -> None:
    found = split_overlap(df, key, splits).first().asDict()
    if any(found.values()):
        raise ValueError(f"the same key is in more than one split: {found}")


def align_check(hyp: DataFrame, ref: DataFrame, on: str) -> DataFrame:
    """One row of id counts. Counts are combined before the shuffle, so repeated ids cost nothing extra."""
    sides = hyp.select(on, F.lit(1).alias("h"), F.lit(0).alias("r")).unionByName(
        ref.select(on, F.lit(0).alias("h"), F.lit(1).alias("r"))
    )
    per_id = sides.groupBy(on).agg(F.sum("h").alias("h"), F.sum("r").alias("r"))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    h, r = F.col("h"), F.col("r")
    return per_id.agg(
        F.coalesce(F.sum("h"), F.lit(0)).alias("n_hyp"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("n_ref"),
        count((h > 0) & (r > 0)).alias("matched"),
        count((h > 0) & (r == 0)).alias("only_hyp"),
        count((h == 0) & (r > 0)).alias("only_ref"),
        count((h > 1) | (r > 1)).alias("repeated"),
    )


def fingerprint(df: DataFrame, on: str, kind: DataType) -> DataFrame:
    """One row that tells multisets of ids apart, whatever their order: rows, nulls, and sums of two 64-bit hashes of the
    id as ``kind``; for whole numbers also the smallest and the largest. Only one row of sums a task is exchanged."""
    key = F.col(f"`{on}`").cast(kind)
    whole = isinstance(kind, IntegralType)
    end = (lambda f: f(key.cast("long"))) if whole else (lambda f: F.lit(None).cast("long"))
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(key.isNull()).alias("nulls"),
        *[
            F.coalesce(F.sum(F.xxhash64(key, F.lit(salt)).cast("decimal(20,0)")), F.lit(0)).alias(f"sum{salt}")
            for salt in (0, 1)
        ],
        end(F.min).alias("low"),
        end(F.max).alias("high"),
    )


def _one_to_one(hyp: DataFrame, ref: DataFrame, on: str) -> bool:
    """Whether both sides are proved to hold the same ids, each once. False proves nothing.

    Equal fingerprints mean equal multisets. Whole numbers that fill their range are distinct if their fingerprint is
    that of the range, which no shuffle takes; of other ids one side's digests are grouped.
    """
    kind = hyp.select(f"`{on}`").union(ref.select(f"`{on}`")).schema[0].dataType
    own = fingerprint(ref, on, kind).first()
    if fingerprint(hyp, on, kind).first() != own:
        return False
    if own.low is not None and not own.nulls and own.high - own.low + 1 == own.n and own.high < 2**63 - 1:
        filled = ref.sparkSession.range(own.low, own.high + 1)
        return fingerprint(filled, "id", kind).first() == own
    key = F.col(f"`{on}`").cast(kind)
    groups = ref.groupBy(F.xxhash64(key, F.lit(0)), F.xxhash64(key, F.lit(1))).count()
    return not groups.filter("count > 1").limit(1).count()


def require_aligned(hyp: DataFrame, ref: DataFrame, on: str) -> None:
    """Raise unless both sides hold the same ids, each once. Sides that do are passed by fingerprint; the grouped check
    runs only where that fails, and gives the counts of the error."""
    if _one_to_one(hyp, ref, on):
        return
    row = align_check(hyp, ref, on).first()
    if row.only_hyp or row.only_ref or row.repeated:
        raise ValueError(f"predictions and references do not match one to one: {row.asDict()}")


def align(hyp: DataFrame, ref: DataFrame, on: str, strict: bool = False) -> DataFrame:
    """Join predictions to references by id; ``strict`` first runs ``require_aligned``."""
    if strict:
        require_aligned(hyp, ref, on)
    return ref.join(hyp, on)
