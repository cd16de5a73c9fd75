"""Places in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pairloom.sources.sinks import stage

EDGES = 64  # keys that cut a bracket into the next ones


def with_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """``df`` with its place from 1 on in a full order. Rows are dealt by range, each range numbers its own, and only one
    count for each range meets in one place. Runs the job that stages the ranges."""
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(out), 33)  # the id is the partition, then the row in it
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    first, total = [], 0
    for row in sorted(counts, key=lambda r: r["part"]):
        first += [F.lit(row["part"]), F.lit(total)]
        total += row["n"]
    if not first:
        return placed
    starts = F.element_at(F.create_map(*first), part)
    return placed.withColumn(out, starts + F.col(out).bitwiseAND((1 << 33) - 1) + 1)


def order_statistic(df: DataFrame, order_by: list[str], n: int) -> tuple[Row, int] | None:
    """The key of the row at place ``n`` (from 1) in ascending order, nulls first, and how many rows with that key are
    among the first ``n``. None with fewer rows.

    Each round draws keys from the bracket that holds the place, counts the rows below each of them in one pass over the
    key columns, and goes on between two of them: no key is sorted but those drawn.
    """
    keys = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order_by)])
    names = keys.columns
    order = F.struct(*names)

    def literal(row: Row) -> Column:
        kinds = [keys.schema[c].dataType for c in names]
        return F.struct(*[F.lit(v).cast(kind).alias(c) for c, v, kind in zip(names, row, kinds, strict=True)])

    low = high = None
    while True:
        bracket = keys if low is None else keys.filter(order > literal(low))
        bracket = bracket if high is None else bracket.filter(order < literal(high))
        drawn = bracket.orderBy(F.xxhash64(F.monotonically_increasing_id(), *names)).limit(EDGES)
        edges = [Row(*[r[c] for c in names]) for r in drawn.distinct().orderBy(*names).collect()]
        if not edges:
            return None
        below = [F.count_if(order < literal(e)).alias(f"lt{i}") for i, e in enumerate(edges)]
        upto = [F.count_if(order <= literal(e)).alias(f"le{i}") for i, e in enumerate(edges)]
        counts = bracket.agg(*below, *upto).first()
        at = next((i for i in range(len(edges)) if counts[f"le{i}"] >= n), None)
        if at is not None and counts[f"lt{at}"] < n:
            return edges[at], n - counts[f"lt{at}"]
        if at is None:
            low, n = edges[-1], n - counts[f"le{len(edges) - 1}"]
        else:
            high = edges[at]
            if at:
                low, n = edges[at - 1], n - counts[f"le{at - 1}"]
