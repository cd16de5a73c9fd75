"""Experiment tables: grids, metrics from logs, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def param_grid(base: DataFrame, **values: list) -> DataFrame:
    """Every row of ``base`` once per combination of the listed values, with ``trial`` counting from 0.

    The lists are options, so the combinations are exploded in place; nothing is joined.
    """
    out, trial = base, F.lit(0)
    for name, options in values.items():
        out = out.select("*", F.posexplode(F.array(*[F.lit(v) for v in options])).alias(f"_{name}", name))
        trial = trial * len(options) + F.col(f"_{name}")
    return out.withColumn("trial", trial).drop(*[f"_{name}" for name in values])


def log_metric(df: DataFrame, col: str, name: str = "eval_geo_mean", out: str | None = None) -> DataFrame:
    """Add the first ``'<name>': <number>`` in a log text as a double; null without one."""
    number = F.regexp_extract(F.col(col), rf"'\Q{name}\E':\s*([\d.]+)", 1)
    return df.withColumn(out or name, number.try_cast("double"))


def leaderboard(trials: DataFrame, metric: str = "geo_mean", order: str = "trial") -> DataFrame:
    """Best first. Missing, NaN and zero results come last. Ties are in trial order: by the text without its last
    number, then by that number, so that trial_2 comes before trial_10."""
    score: Column = F.when((F.col(metric) > 0) & ~_is_nan(metric), F.col(metric)).otherwise(F.lit(-1.0))
    name = F.col(order).cast("string")
    number = F.regexp_extract(name, r"(\d+)$", 1).try_cast("decimal(38,0)")
    return trials.orderBy(score.desc(), F.regexp_replace(name, r"\d+$", ""), number, order)


def _is_nan(metric: str) -> Column:
    return F.isnan(F.col(metric).cast("double"))


def best_step(metrics: DataFrame, by: tuple[str, ...] = (), step: str = "step", metric: str = "geo_mean") -> DataFrame:
    """The step with the highest metric, the lowest step on ties; rows without a metric, or with NaN, do not count."""
    scored = metrics.filter(F.col(metric).isNotNull() & ~_is_nan(metric))
    best = F.max(F.struct(F.col(metric), -F.col(step))).alias("_best")
    chosen = scored.groupBy(*by).agg(best)
    return chosen.select(*by, (-F.col("_best.col2")).alias(step), F.col(f"_best.{metric}").alias(metric))
