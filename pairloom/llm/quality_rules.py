"""Quality rules as weak supervision, in DataFrame expressions alone.

Seven rules vote good (1), bad (-1) or abstain (0) on a text. Expectation-maximisation over the counts of the
vote patterns estimates how often each rule is right on good texts and on each kind of bad text, and how common
these are (bad texts differ in kind, so one bad class would let the commonest kind outvote the rest); a text is kept when its
posterior probability of being good is at least one half. There are at most 3^7 patterns, whatever the input.

Null and empty texts have no words: they fail the base rules. Repeated rows are judged row by row. An empty table
gives an empty result. The columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import stage

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOPS = ".!?"
WINDOW = 5
MOST_WRONG = 0.005


@dataclass
class Model:
    """Latent classes: good texts first, then one class of bad texts per rule. For each class its share, and for
    each rule the probabilities of its votes (-1, 0, 1) on texts of that class."""

    shares: list[float]
    chances: list[list[dict[int, float]]]


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _shifted(a: Column, b: Column, skip: int, n: Column) -> Column:
    """Hashes of the pairs (a[i], b[i + skip]) for the first ``n`` i."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + skip), n), lambda x, y: F.xxhash64(x, y))


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every text: words, their code points, symbols, stops, repeated lines, words inside 5-word
    windows found twice or more, distinct words."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.select(F.col(key).alias("key"), body.alias("body"))
    trimmed = F.btrim("body", F.lit(BLANKS))
    lines = F.filter(F.split("body", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    df = df.select(
        "key",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("words"),
        F.length(F.translate("body", BLANKS, "")).cast("long").alias("word_chars"),
        _count_of(F.col("body"), SYMBOLS).cast("long").alias("n_symbols"),
        _count_of(F.col("body"), STOPS).cast("long").alias("n_stops"),
        lines.alias("lines"),
    )
    counts = ["key", "word_chars", "n_symbols", "n_stops"]
    df = df.select(
        *counts,
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    counts += ["n_words", "n_distinct", "n_lines", "n_dup_lines"]
    n = F.size("h")
    long_enough = n >= WINDOW
    none = F.array().cast("array<bigint>")
    df = df.select(*counts, "h", F.when(long_enough, _shifted(F.col("h"), F.col("h"), 1, n - 1)).alias("h2"))
    df = df.select(*counts, "h", F.when(long_enough, _shifted(F.col("h2"), F.col("h2"), 2, n - 3)).alias("h4"))
    df = df.select(
        *counts, F.coalesce(F.when(long_enough, _shifted(F.col("h4"), F.col("h"), 4, n - 4)), none).alias("h5")
    )
    return df.select(*counts, _repeated_words(F.col("h5")).alias("n_repeat_words"))


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. Only texts with such windows are sorted."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    same = F.zip_with(
        F.slice(placed, F.lit(1), n - 1),
        F.slice(placed, F.lit(2), n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(same)))
    k = F.size(starts)
    gaps = F.zip_with(
        F.slice(starts, F.lit(1), k - 1),
        F.slice(starts, F.lit(2), k - 1),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(covered).cast("long")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _rate(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


# name -> vote; thresholds are on rates, so texts of all lengths are judged alike. Rules that look for one defect
# abstain without it: its absence says little.
RULES = ("length", "symbols", "repeats", "lines", "variety", "word_length", "sentences")


def rules() -> dict[str, Column]:
    abstain = F.lit(False)
    long_enough = F.col("n_words") >= 30
    word_length = _rate("word_chars", "n_words")
    stops = _rate("n_stops", "n_words")
    return {
        "length": _vote(long_enough, F.col("n_words") < 10),
        "symbols": _vote(abstain, _rate("n_symbols", "n_words") > 0.2),
        "repeats": _vote(abstain, _rate("n_repeat_words", "n_words") > 0.2),
        "lines": _vote(abstain, _rate("n_dup_lines", "n_lines") > 0.3),
        "variety": _vote(abstain, long_enough & (_rate("n_distinct", "n_words") < 0.15)),
        "word_length": _vote(abstain, ~word_length.between(2, 15)),
        "sentences": _vote(stops >= 0.02, long_enough & (stops < 0.004)),
    }


def votes(counts: DataFrame) -> DataFrame:
    return counts.select("*", F.array(*(rules()[name] for name in RULES)).alias("votes"))


def start() -> Model:
    """Good texts draw few bad votes; each kind of bad text draws the bad vote of the rule made for it,
    and else the votes of good texts."""
    n = len(RULES)
    good = [{-1: 0.01, 0: 0.49, 1: 0.5} for _ in RULES]
    bad = [[{-1: 0.9, 0: 0.05, 1: 0.05} if k == own else good[k] for k in range(n)] for own in range(n)]
    return Model([0.8, *[0.2 / n] * n], [good, *bad])


def posterior(model: Model, votes: Column) -> Column:
    """Probability that a text is good, the votes being independent given its class."""
    ratios = []  # of each bad class to good
    for share, chances in zip(model.shares[1:], model.chances[1:], strict=True):
        odds = F.lit(math.log(share / model.shares[0]))
        for k, (own, good) in enumerate(zip(chances, model.chances[0], strict=True)):
            weight = {v: math.log(own[v] / good[v]) for v in (-1, 0, 1)}
            odds = odds + F.element_at(F.array(*[F.lit(weight[v]) for v in (-1, 0, 1)]), votes[k] + 2)
        ratios.append(F.exp(odds))
    return 1 / (1 + sum(ratios[1:], ratios[0]))


def _improved(model: Model, counts: list[tuple[tuple[int, ...], int]]) -> Model:
    """One round of expectation and maximisation, smoothed by one vote of each kind in each class. The rule of a
    bad class keeps at least half of its weight on bad votes there, and no rule votes against more than MOST_WRONG of
    the good texts: from the votes alone a rule that is often wrong and a common defect look the same."""
    total, n_classes = sum(n for _, n in counts), len(model.shares)
    sizes = [1.0] * n_classes
    voted = [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in RULES] for _ in range(n_classes)]
    for pattern, n in counts:
        joint = list(model.shares)
        for c in range(n_classes):
            for k, v in enumerate(pattern):
                joint[c] *= model.chances[c][k][v]
        for c in range(n_classes):
            weight = n * joint[c] / sum(joint)
            sizes[c] += weight
            for k, v in enumerate(pattern):
                voted[c][k][v] += weight
    for own in range(len(RULES)):
        mine, good = voted[own + 1][own], voted[0][own]
        mine[-1] = max(mine[-1], mine[0] + mine[1])
        good[-1] = min(good[-1], MOST_WRONG * (good[0] + good[1]))
    chances = [[{v: x / sum(rule.values()) for v, x in rule.items()} for rule in rules] for rules in voted]
    return Model([size / (total + n_classes) for size in sizes], chances)


def fit(voted: DataFrame, rounds: int = 20) -> Model:
    """Expectation-maximisation over the counts of the vote patterns: at most 3^7 rows reach the driver, as there
    are no more patterns."""
    rows = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    counts = sorted((tuple(row["votes"]), row["n"]) for row in rows)
    model = start()
    for _ in range(rounds if counts else 0):
        model = _improved(model, counts)
    return model


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base verdict, posterior quality and verdict of every row."""
    voted = stage(votes(features(df, key, text)), "votes")
    model = fit(voted)
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    base_failed = (n < 10) | (100 * repeated > 20 * n)
    quality = posterior(model, F.col("votes"))
    return voted.select(
        F.col("key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (quality >= 0.5)).alias("kept"),
        quality.alias("quality"),
    )
