"""URL filtering by host and path rules, and by association rules mined from the urls that these decide.

A rule is a host with a path prefix, like ``example.net/en/``. It fits its host and all subdomains when the path of
the url starts with the path of the rule; the longest fitting rule decides. The urls so decided are labels: FP-growth
mines the token combinations that are frequent among them together with a verdict, and combinations of enough
support and confidence become association rules. A url that no host rule fits gets the verdict of the best
association rule that it contains; without one it is allowed. Association rules are matched by an inverted index:
each is listed under its rarest token, so a url looks only at the rules listed under tokens it has.

Tokens are words of the host, the top-level domain, path words by depth up to MOST_DEPTH, and query names. A host or path with more words has more tokens; none is left out, but words deeper than MOST_DEPTH share the
last depth. Combinations of any number of tokens become rules.

Mining leaves out what can add no better rule. A token that only urls of one verdict have is a rule of confidence 1
alone, and with further tokens only a rarer one. Tokens that exactly the same decided urls have stand for each other:
they are one item, so a template of many tokens does not bring about all its subsets. Both leave the best rule of every
url as it was. What remains are tokens that come with either verdict; if many of them come and go independently in most
urls, their frequent combinations are many, and so is the work of FP-growth. Very long urls add tokens, not combinations.

A null url, or one without ``://``, has an empty host and path, no rule and, as it has no token, the verdict allow.
Rows are judged one by one, so repeated rows get equal results; an empty table gives an empty result; without any
decided url there are no association rules. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import stage

# (verdict, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
SUPPORT = 0.01  # share of the decided urls that have the combination and the verdict
LEAST_ROWS = 2  # and their number: one url is no evidence
COMMON = 0.98  # tokens in more of the decided urls tell nothing
CONFIDENCE = 0.8
MOST_DEPTH = 4
VERDICTS = ("allow", "block")
LABEL = "verdict="


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def host_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one."""
    name = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda word: word != "")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url. Numbers in paths count as one word."""
    plain = F.lower(F.coalesce(url, F.lit("")))
    depth = lambda i: F.least(i, F.lit(MOST_DEPTH)).cast("string")
    named = [
        F.transform(_split(host, r"[.:@_-]"), lambda w: F.concat(F.lit("host="), w)),
        F.flatten(
            F.transform(
                _split(F.lower(path), "/"),
                lambda segment, i: F.transform(
                    _split(F.regexp_replace(segment, r"[0-9]+", "0"), r"[^\p{L}0-9]+"),
                    lambda w: F.concat(F.lit("path"), depth(i), F.lit("="), w),
                ),
            )
        ),
        F.transform(
            _split(F.regexp_extract(plain, r"\?([^#]*)", 1), "&"),
            lambda w: F.concat(F.lit("query="), F.substring_index(w, "=", 1)),
        ),
        F.when(host != "", F.array(F.concat(F.lit("top="), F.substring_index(host, ".", -1)))).otherwise(
            F.array().cast("array<string>")
        ),
    ]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*named)))


def frequent_tokens(decided: DataFrame, support: float = SUPPORT) -> tuple[dict[str, tuple], int, int]:
    """By token: its item (the smallest token that exactly the same urls have), urls and blocked urls, of the tokens that
    are frequent but not common; the least number of rows of a rule, and all rows.

    The tokens that come to the driver are at most the average tokens of a url / ``support``. Equal sets of urls are known
    by sums of two 64-bit hashes.
    """
    total = decided.count()
    least = max(LEAST_ROWS, math.ceil(support * total))
    rows = decided.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", (F.col("verdict") == "block").alias("blocked"), F.explode("tokens").alias("token"))
    sums = [F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(20,0)")).alias(f"sum{salt}") for salt in (0, 1)]
    counts = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), *sums)
    found = counts.where((F.col("n") >= least) & (F.col("n") <= COMMON * total)).collect()
    item: dict[tuple, str] = {}
    for r in found:
        urls = (r["n"], r["sum0"], r["sum1"])
        item[urls] = min(r["token"], item.get(urls, r["token"]))
    return {r["token"]: (item[r["n"], r["sum0"], r["sum1"]], r["n"], r["blocked"]) for r in found}, least, total


def mine(
    decided: DataFrame,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    known: tuple[dict[str, tuple], int, int] | None = None,
) -> list[dict]:
    """Association rules from (tokens, verdict), over the items of ``frequent_tokens``: tokens, verdict, n and confidence c.
    A combination with a token that is a rule of confidence 1 is not looked at; one that a combination with one item
    less implies stays behind in Spark."""
    tokens_, least, total = known or frequent_tokens(decided, support)
    sure = [
        {"tokens": [t], "verdict": VERDICTS[int(blocked > 0)], "n": n, "c": 1.0}
        for t, (item, n, blocked) in tokens_.items()
        if item == t and blocked in (0, n)
    ]
    open_items = {t: item for t, (item, n, blocked) in tokens_.items() if 0 < blocked < n}
    if not open_items:
        return sure

    def to_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            items = [[*{open_items[t] for t in own if t in open_items}, LABEL + verdict] for own, verdict in rows]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    items = decided.select("tokens", "verdict").mapInArrow(to_items, "items array<string>")
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=confidence).fit(items).freqItemsets
    is_label = lambda t: F.startswith(t, F.lit(LABEL))
    sets = sets.select(
        F.array_sort(F.filter("items", lambda t: ~is_label(t))).alias("tokens"),
        F.get(F.filter("items", is_label), F.lit(0)).alias("label"),
        "freq",
    ).where(F.size("tokens") >= 1)
    whole = sets.where("label is null").select("tokens", F.col("freq").alias("n"))
    rules = (
        sets.where("label is not null")
        .join(whole, "tokens")
        .select(
            "tokens",
            F.substring("label", len(LABEL) + 1, 10).alias("verdict"),
            "n",
            (F.col("freq") / F.col("n")).alias("c"),
        )
        .where(F.col("c") >= confidence)
    )
    rules = stage(rules, "url-rules")
    without_one = F.transform("tokens", lambda _, i: F.filter("tokens", lambda _, j: j != i))
    longer = rules.select("tokens", "verdict", "c", F.explode(without_one).alias("shorter"))
    shorter = rules.select(F.col("tokens").alias("shorter"), "verdict", F.col("c").alias("least"))
    implied = longer.join(shorter, ["shorter", "verdict"]).where("least >= c").select("tokens", "verdict")
    return sure + [row.asDict() for row in rules.join(implied, ["tokens", "verdict"], "left_anti").collect()]


def indexed(rules: list[dict]) -> dict[str, list[tuple]]:
    """Association rules by their rarest token (of the tokens that are rules alone or not), best rule first. A rule
    that a shorter one with at least its confidence implies is pruned."""
    best = {(tuple(r["tokens"]), r["verdict"]): r["c"] for r in rules}
    counts: dict[str, int] = {}
    for r in rules:
        for t in r["tokens"]:
            counts[t] = max(counts.get(t, 0), r["n"])
    index: dict[str, list[tuple]] = {}
    for r in rules:
        own = tuple(r["tokens"])
        shorter = [own[:i] + own[i + 1 :] for i in range(len(own))]
        if any(best.get((s, r["verdict"]), 0) >= r["c"] for s in shorter if s):
            continue
        rarest = min(own, key=lambda t: (counts[t], t))
        index.setdefault(rarest, []).append((r["c"], r["n"], frozenset(own), r["verdict"]))
    return {t: sorted(found, key=lambda r: (-r[0], -r[1], sorted(r[2]))) for t, found in index.items()}


def matched(index: dict[str, list[tuple]], own: list[str]) -> tuple[str, float | None]:
    """Verdict and confidence of the best rule within a url's tokens; ties go to support, then to block."""
    have, best = set(own), None
    for t in own:
        for confidence, n, wanted, verdict in index.get(t, ()):
            if best and (confidence, n) < best[:2]:
                break
            if wanted <= have:
                found = (confidence, n, verdict)
                best = max(best, found) if best else found
    return (best[2], best[0]) if best else ("allow", None)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Host, path, fitting rule and verdict of every row, and the confidence where an association rule decided."""
    host, path = parts(F.col(url))
    df = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = host_rule(F.col("host"), F.col("path"), rules)
    own = tokens(F.col("url"), F.col("host"), F.col("path"))
    df = df.select("key", "host", "path", name.alias("rule"), verdict.alias("verdict"), own.alias("tokens"))
    decided = df.where("rule is not null").select("tokens", "verdict")
    known = frequent_tokens(decided)
    index, item_of = indexed(mine(decided, known=known)), {t: item for t, (item, *_) in known[0].items()}

    def by_association(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[item_of.get(t, t) for t in own or []] for own in batch.column("tokens").to_pylist()]
            found = [matched(index, own) for own in items]
            rows = batch.drop_columns("tokens")
            decided = rows.column("verdict").is_valid().to_pylist()
            by_rule = rows.column("verdict").to_pylist()
            verdict = [own if ok else v for own, ok, (v, _) in zip(by_rule, decided, found, strict=True)]
            confidence = [None if ok else c for ok, (_, c) in zip(decided, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array(verdict, pa.string()), pa.array(confidence, pa.float64())],
                [*rows.schema.names, "confidence"],
            )

    schema = df.drop("tokens").schema.add("confidence", "double")
    return df.mapInArrow(by_association, schema).withColumnRenamed("key", key)
