"""Closed-form chrF and BLEU from summed counts, as Spark expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def chrf(hyp: list[Column], ref: list[Column], shared: list[Column], beta: float = 2.0) -> Column:
    """chrF over n-gram orders; an order counts only when both sides have n-grams of it."""
    used = [(h > 0) & (r > 0) for h, r in zip(hyp, ref)]
    orders = _total([u.cast("int") for u in used])
    zero = F.lit(0.0)
    precision = F.try_divide(_total([F.when(u, m / h).otherwise(zero) for u, m, h in zip(used, shared, hyp)]), orders)
    recall = F.try_divide(_total([F.when(u, m / r).otherwise(zero) for u, m, r in zip(used, shared, ref)]), orders)
    score = F.try_divide(100 * (1 + beta**2) * precision * recall, beta**2 * precision + recall)
    return F.when(hyp[0].isNotNull(), F.coalesce(score, zero))


def bleu(shared: list[Column], total: list[Column], hyp_len: Column, ref_len: Column) -> Column:
    """BLEU with exponential smoothing: the k-th order without a match gets precision 1/(2^k total)."""
    logs, misses = [], F.lit(0)
    for m, t in zip(shared, total):
        misses = misses + (m == 0).cast("int")
        logs.append(F.ln(F.when(m > 0, 100.0 * m / t).otherwise(F.try_divide(F.lit(100.0), F.pow(F.lit(2.0), misses) * t))))
    brevity = F.when(hyp_len < ref_len, F.exp(1 - F.try_divide(ref_len, hyp_len))).otherwise(1.0)
    defined = (_total(shared) > 0) & reduce(lambda a, b: a & b, [t > 0 for t in total])
    score = F.when(defined, brevity * F.exp(_total(logs) / len(shared))).otherwise(0.0)
    return F.when(hyp_len.isNotNull(), score)
