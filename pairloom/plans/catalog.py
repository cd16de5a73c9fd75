"""One runnable query per operator over the given tables.

The tables hold no translations, so views over them stand in: a turn and the next turn of a conversation, a
document and a respelled copy of it, the turns of a conversation as candidates, events as training logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import corpus, encoding, metrics, orthography, selection, trials
from pairloom.sources import readers, sinks

LATIN_GROUPS = [list("eéèêë"), list("aáàâä"), list("iíîï"), list("oóôö"), list("uúùûü"), list("nñ"), list("cç")]
FOLD = {ch: group[0] for group in LATIN_GROUPS for ch in group[1:]}
LATIN_VARIANTS = {
    "folded": FOLD,
    "umlauts_kept": {k: v for k, v in FOLD.items() if k not in "äöü"},
    "graves": {"é": "è", "ê": "è", "á": "à", "â": "à"},
}
DECOMPOSED = {"é": "e\u0301", "è": "e\u0300", "ä": "a\u0308", "ñ": "n\u0303", "ç": "c\u0327"}
VOCAB = 1000
ARABIC_VOWELS = "اےیوہ"  # stand-ins, so that the target has Arabic letters


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, f"{sf_dir}/conversations.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by key in ``spark.sql.shuffle.partitions`` parts. Named by number, so that Spark does not merge them by
    bytes into few parts, a second wave of which then waits for one task: scoring costs far more than reading."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _respelled(col: str):
    return F.replace(F.replace(F.col(col), F.lit("ou"), F.lit("u")), F.lit(" and "), F.lit(" "))


def parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw pairs: padded source, target blank for short documents."""
    target = F.when(F.col("n_chars") < 200, F.lit(" \t")).otherwise(F.concat(F.lit(" "), _respelled("text")))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("pair_id"),
        F.concat(F.lit("  "), F.col("text"), F.lit("\r\n")).alias("source"),
        target.alias("target"),
    )


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference: the document; prediction: the document respelled. Placed by id, as joined predictions are."""
    rows = spread(documents(spark, sf_dir).select("doc_id", "lang", "text"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), "lang", _respelled("text").alias("hyp"), F.col("text").alias("ref"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction: a turn; reference: the next turn."""
    turns = conversations(spark, sf_dir)
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    joined = turns.join(following, ["conv_id", "turn"])
    return joined.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("hyp"), "ref")


def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for whole, parts in DECOMPOSED.items():
        text = F.replace(text, F.lit(whole), F.lit(parts))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select(
        F.col("conv_id").alias("id"),
        F.col("role").alias("model"),
        F.col("turn").alias("model_step"),
        F.col("turn").alias("pos"),
        "text",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines; clicks carry no metric."""
    events = readers.read_table(spark, f"{sf_dir}/events.parquet")
    found = F.concat(F.lit("{'loss': 1.5, 'eval_geo_mean': "), F.col("value").cast("string"), F.lit(", 'eval_BLEU': 2.0}"))
    line = F.when(F.col("event_type") == "click", "{'loss': 1.5}").otherwise(found)
    return events.select("event_id", "event_type", "user_id", line.alias("line"))


def trial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per (user, event type): the highest logged metric, null when none was logged."""
    metric = trials.log_metric(logs(spark, sf_dir), "line", out="geo_mean")
    trial = F.concat_ws("-", "event_type", "user_id").alias("trial")
    return metric.groupBy(trial).agg(F.max("geo_mean").alias("geo_mean"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orthography.char_counts(documents(spark, sf_dir), "text")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.with_pieces(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "text")


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _joined(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in cols})


def clean_pairs(spark, d):
    return corpus.clean_pairs(parallel(spark, d))


def dedup_first(spark, d):
    return corpus.dedup_first(documents(spark, d).select("doc_id", "text", "lang", "source"), ["text"], ["doc_id"])


def script_ratio(spark, d):
    return documents(spark, d).groupBy("lang").agg(
        F.round(corpus.script_ratio(F.col("text"), T.LATIN), 6).alias("latin"),
        F.round(corpus.script_ratio(F.col("text"), r"À-ɏ"), 6).alias("accented"),
        F.round(corpus.script_ratio(F.col("text"), T.ARABIC), 6).alias("arabic"),
    )


def script_guard(spark, d):
    docs = documents(spark, d).withColumn("target", F.translate("text", "aeiou", ARABIC_VOWELS))
    return _r(corpus.check_scripts(docs, "text", "target", ("doc_id",)), "source_ratio", "target_ratio")


def target_guard(spark, d):
    docs = documents(spark, d).withColumn("target", F.translate("text", "aeiou", ARABIC_VOWELS))
    found = corpus.check_scripts(docs, "target", "target", ("doc_id",), target_class=T.ARABIC_NARROW, source_min=0.0)
    return _r(found, "source_ratio", "target_ratio")


def hash_split(spark, d):
    return corpus.hash_split(documents(spark, d).select("doc_id", "text"), "text").select("doc_id", "split")


def split_sizes(spark, d):
    return corpus.split_sizes(corpus.hash_split(documents(spark, d).select("doc_id", "text"), "text"))


def exact_split(spark, d):
    return corpus.exact_split(documents(spark, d).select("doc_id"), "doc_id")


def split_overlap(spark, d):
    """Split by document id, so that copies of a text can land in different splits and be found."""
    return corpus.split_overlap(corpus.hash_split(documents(spark, d).select("doc_id", "text"), "doc_id"), "text")


def seeded_sample(spark, d):
    return corpus.seeded_sample(documents(spark, d).select("doc_id", "lang", "text"), "doc_id", 500)


def head_eval(spark, d):
    return corpus.head_n(noisy(spark, d), ["id"], 500)


def nfc_text(spark, d):
    return decomposed(spark, d).withColumn("text", T.nfc(F.col("text")))


def char_counts(spark, d):
    return _r(counts(spark, d), "pct")


def top_chars(spark, d):
    return _r(orthography.top_chars(counts(spark, d), 50), "pct")


def variant_usage(spark, d):
    usage = orthography.variant_usage(counts(spark, d), LATIN_GROUPS)
    return _r(usage, "pct_of_group").withColumn("rank", F.col("rank").cast("long"))


def learn_char_map(spark, d):
    return orthography.learn_char_map(counts(spark, d), LATIN_GROUPS)


def char_map_merge(spark, d):
    docs = documents(spark, d)
    old = orthography.learn_char_map(orthography.char_counts(docs.filter("lang = 'de'"), "text"), LATIN_GROUPS, 0.5)
    return orthography.merge_char_map(old, orthography.learn_char_map(counts(spark, d), LATIN_GROUPS))


def char_map_apply(spark, d):
    return orthography.normalize_column(decomposed(spark, d), "text", FOLD)


def variant_fanout(spark, d):
    return orthography.expand_variants(documents(spark, d).select("doc_id", "text"), "text", LATIN_VARIANTS)


def prefix_source(spark, d):
    docs = documents(spark, d).select("doc_id", "text")
    return docs.withColumn("text", T.with_prefix(F.col("text"), "eng_Latn kas_Arab "))


def suffix_attach(spark, d):
    return orthography.normalize_column(documents(spark, d).select("doc_id", "text"), "text", suffixes=[("tion", True)])


def suffix_detach(spark, d):
    return orthography.normalize_column(documents(spark, d).select("doc_id", "text"), "text", suffixes=[("ment", False)])


def tokenize(spark, d):
    tokens = documents(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    return _joined(tokens.withColumn("n", F.size("tokens").cast("long")), "tokens")


def token_prf(spark, d):
    return _r(metrics.token_prf(noisy(spark, d)), "precision", "recall", "f1").drop("hyp", "ref")


def token_prf_macro(spark, d):
    return _r(metrics.token_prf_macro(spread(pairs(spark, d), "id")), "precision", "recall", "f1")


def length_stats(spark, d):
    return _r(metrics.length_stats(noisy(spark, d), by=("lang",)), "rmse", "pearson", "r2")


def exact_match(spark, d):
    return _r(metrics.exact_match(noisy(spark, d), by=("lang",)), "accuracy")


def exact_match_missing(spark, d):
    """Predictions of fewer than 80 characters are missing; a missing one counts as wrong, not as absent."""
    missing = F.when(F.length("hyp") >= 80, F.col("hyp"))
    both = pairs(spark, d).withColumn("hyp", missing).withColumn("ref", F.coalesce("hyp", "ref"))
    return _r(metrics.exact_match(both), "accuracy")


def align_check(spark, d):
    labels = readers.read_table(spark, f"{d}/labels.parquet")
    return corpus.align_check(labels, readers.read_table(spark, f"{d}/documents.parquet"), "doc_id")


def scored_pairs(spark, d):
    turns = conversations(spark, d).withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    prediction = pairs(spark, d).select("id", F.col("ref").alias("predicted_text"))
    return corpus.align(prediction, turns, "id").select("id", "role", "text", "predicted_text")


def submission(spark, d):
    renamed = documents(spark, d).withColumnRenamed("doc_id", "ID")
    return sinks.submission(renamed.withColumn("out", _respelled("text")), "ID", "out")


def _orders(df: DataFrame, hyp, ref, shared) -> DataFrame:
    zipped = F.arrays_zip(hyp.alias("h"), ref.alias("r"), shared.alias("m"))
    rows = df.select("id", F.posexplode(zipped).alias("ord", "v"))
    return rows.select("id", (F.col("ord") + 1).cast("long").alias("ord"), "v.h", "v.r", "v.m")


def chrf_stats(spark, d):
    counted = metrics.chrf_vectors(noisy(spark, d))
    return _orders(counted, F.col("chrf_hyp"), F.col("chrf_ref"), F.col("chrf_shared"))


def chrf_grams(spark, d):
    grams = metrics.gram_counts(pairs(spark, d))
    return grams.withColumn("ord", F.col("ord").cast("long"))


def chrf_corpus(spark, d):
    return _r(metrics.chrf_corpus(noisy(spark, d), by=("lang",)), "chrf")


def bleu_stats(spark, d):
    counted = metrics.bleu_vectors(noisy(spark, d))
    ref_total = F.array(*[F.greatest(F.col("ref_len") - n, F.lit(0).cast("long")) for n in range(4)])
    return _orders(counted, F.col("bleu_total"), ref_total, F.col("bleu_correct"))


def bleu_corpus(spark, d):
    return _r(metrics.bleu_corpus(noisy(spark, d), by=("lang",)), "bleu")


REPORT = ("chrf", "bleu", "geo_mean", "accuracy", "precision", "recall", "f1", "rmse", "pearson", "r2")


def corpus_report(spark, d):
    return _r(metrics.corpus_report(noisy(spark, d)), *REPORT)


def corpus_report_pairs(spark, d):
    return _r(metrics.corpus_report(spread(pairs(spark, d), "id")), *REPORT)


def sentence_scores(spark, d):
    scored = metrics.with_sentence_scores(metrics.bleu_vectors(metrics.chrf_vectors(spread(pairs(spark, d), "id"))))
    return _r(scored.select("id", "chrf", "bleu"), "chrf", "bleu")


def regroup_flat(spark, d):
    flat = conversations(spark, d).withColumn("pos", F.col("conv_id") * 8 + F.col("turn"))
    return selection.regroup_flat(flat.select("pos", "text"), "pos", 4).withColumn("rank", F.col("rank").cast("long"))


def candidate_pool(spark, d):
    parts = [
        candidates(spark, d).filter(F.col("model") == role).select("id", "model", F.col("pos").alias("rank"), "text")
        for role in ("user", "assistant", "system")
    ]
    return selection.candidate_pool(*parts, priority=(1, 0, 2))


def candidate_dedup(spark, d):
    return selection.candidate_dedup(candidates(spark, d))


def latest_models(spark, d):
    return selection.latest_models(candidates(spark, d), 2)


def mbr_utilities(spark, d):
    scored = selection.mbr_utilities(candidates(spark, d))
    return _r(scored, "chrf", "bleu", "utility").drop("text")


def mbr_select(spark, d):
    return _r(selection.mbr_select(selection.mbr_utilities(candidates(spark, d))), "utility")


def mbr_choose(spark, d):
    return _r(selection.mbr_choose(candidates(spark, d), block=4), "utility").drop("scored")


def mbr_weighted(spark, d):
    """Turns weigh by how long their text is, modulo 5; repeats add up."""
    weighted = candidates(spark, d).withColumn("w", F.length("text") % 5 + 0.5)
    return _r(selection.mbr_utilities(weighted, weight="w"), "chrf", "bleu", "utility").drop("text")


def build_vocab(spark, d):
    return encoding.build_vocab(pieces(spark, d), size=VOCAB)


def encode_labels(spark, d):
    rows = pieces(spark, d)
    vocab = sinks.stage(encoding.build_vocab(rows, size=VOCAB))
    return _joined(encoding.encode_labels(rows, vocab), "labels")


def encode_inputs(spark, d):
    rows = pieces(spark, d)
    vocab = sinks.stage(encoding.build_vocab(rows, size=VOCAB))
    return _joined(encoding.encode_inputs(rows, vocab), "input_ids", "attention_mask")


def decode_labels(spark, d):
    rows = pieces(spark, d)
    vocab = sinks.stage(encoding.build_vocab(rows, size=VOCAB))
    labels = encoding.encode_labels(rows, vocab)
    return encoding.decode_labels(labels, vocab)


def param_grid(spark, d):
    base = readers.read_table(spark, f"{d}/events.parquet").select("event_type").distinct()
    return trials.param_grid(base, lora_r=[4, 8, 16], learning_rate=[3e-5, 5e-5])


def log_metric(spark, d):
    return trials.log_metric(logs(spark, d), "line").select("event_id", "eval_geo_mean")


def leaderboard(spark, d):
    return trials.leaderboard(trial_results(spark, d))


def best_step(spark, d):
    found = trials.log_metric(logs(spark, d), "line", out="geo_mean")
    return trials.best_step(found, by=("user_id",), step="event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_pairs, dedup_first, script_ratio, script_guard, target_guard, hash_split, split_sizes, split_overlap, exact_split,
        seeded_sample, head_eval, nfc_text, char_counts, top_chars, variant_usage, learn_char_map, char_map_merge,
        char_map_apply, variant_fanout, prefix_source, suffix_attach, suffix_detach, tokenize, token_prf,
        token_prf_macro, length_stats, exact_match, exact_match_missing, align_check, scored_pairs, submission, chrf_stats, chrf_grams,
        chrf_corpus, bleu_stats, bleu_corpus, corpus_report, corpus_report_pairs, sentence_scores, regroup_flat,
        candidate_pool, candidate_dedup, latest_models, mbr_utilities, mbr_select, mbr_choose, mbr_weighted, build_vocab, encode_labels,
        encode_inputs, decode_labels, param_grid, log_metric, leaderboard, best_step,
    )
}
