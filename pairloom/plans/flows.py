"""End-to-end flows: corpus to splits, candidates to a submission, predictions to a report, pairs to training rows,
a table to spelling rules, a submission to its variants, a prediction file to its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import corpus, encoding, metrics, orthography, selection
from pairloom.sources import readers, sinks


def prepare_corpus(
    spark: SparkSession,
    tsv: str,
    out: str,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    exact: bool = False,
    fmt: str = "parquet",
    multi_line: bool = True,
) -> DataFrame:
    """Read, clean, deduplicate, guard, split, prove the splits disjoint, write. Returns the split sizes.

    The deduplicated table is staged, as the guards and the writer each read it. Nothing is written to
    ``out`` unless both guards pass.
    """
    pairs = corpus.clean_pairs(readers.read_parallel(spark, tsv, multi_line=multi_line))
    kept = sinks.stage(corpus.dedup_first(pairs, ["source"], ["origin", "pair_id"]))
    corpus.require_scripts(kept, order_by=("origin", "pair_id"))
    split = (corpus.exact_split if exact else corpus.hash_split)(kept, "source", val=val, test=test, seed=seed)
    corpus.require_disjoint(split, "source")
    sinks.write_splits(split.drop("origin", "pair_id"), out, fmt=fmt)
    return corpus.split_sizes(split)


def choose_candidates(
    cands: DataFrame, rules: readers.Rules | None = None, metric: str = "geo", models: int = 0
) -> DataFrame:
    """Candidates (id, model, model_step, pos, text) to one text per id (id, pos, text, utility).

    Keep the latest ``models`` (0: all), apply the spelling rules, choose by consensus, apply the rules once more
    (suffix rules need not be idempotent).
    """
    rules = rules or readers.Rules()
    pool = selection.latest_models(cands, models) if models else cands
    pool = orthography.normalize_column(pool, "text", rules.char_map, rules.suffixes)
    chosen = selection.mbr_select(selection.mbr_utilities(pool, metric))
    return orthography.normalize_column(chosen, "text", rules.char_map, rules.suffixes)


def evaluate(
    predictions: DataFrame, references: DataFrame, on: str, hyp: str, ref: str, n: int = 0, out: str | None = None
) -> DataFrame:
    """Score predictions of the first ``n`` references (0: all); optionally write the scored table. Predictions are
    staged, so they are computed once for the guard, the file and the report."""
    head = corpus.head_n(references, [on], n)
    wanted = sinks.stage(predictions.join(head.select(on), on, "left_semi") if n else predictions)
    scored = corpus.align(wanted, head, on, strict=True)
    if out:
        sinks.write_scored(scored, out)
    return metrics.corpus_report(scored, hyp, ref)


def training_table(
    pairs: DataFrame,
    folder: str,
    inputs: dict,
    prefix: str = "",
    sample: int = 0,
    vocab_size: int = 32_000,
    max_len: int = 128,
    seed: int = 42,
    guard: bool = True,
) -> DataFrame:
    """Pairs (pair_id, source, target) to (pair_id, input_ids, attention_mask, labels), materialised in ``folder``.

    The target script is checked, sources get ``prefix``, one vocabulary is built from both sides, and both sides are
    encoded in one table. The table is reused while the files of ``pairs``, ``inputs`` (whatever else describes them, see
    ``sinks.materialise_from``) and the options stay the same; then nothing is read, checked or encoded again. ``sample``
    takes that many rows (0: all). ``pair_id`` must be unique: it joins the two sides.
    """

    def build() -> DataFrame:
        if guard:
            corpus.require_target_script(pairs)
        rows = corpus.seeded_sample(pairs, "pair_id", sample, seed) if sample else pairs
        rows = rows.select("pair_id", T.with_prefix(F.col("source"), prefix).alias("source"), "target")
        rows = sinks.stage(rows)
        texts = rows.select(F.explode(F.array("source", "target")).alias("text"))
        vocab = sinks.stage(encoding.build_vocab(encoding.with_pieces(texts, "text"), size=vocab_size))
        sides = [encoding.with_pieces(rows.select("pair_id", c), c) for c in ("source", "target")]
        encoded = encoding.encode_inputs(sides[0], vocab, "pair_id", max_len=max_len)
        return encoded.join(encoding.encode_labels(sides[1], vocab, "pair_id", max_len=max_len), "pair_id")

    options = {"prefix": prefix, "sample": sample, "vocab": vocab_size, "max_len": max_len, "seed": seed}
    return sinks.materialise_from(pairs, folder, {**inputs, **options}, build)


def learn_spelling(
    df: DataFrame, groups: list[list[str]], out: str, column: str | None = None, rules: readers.Rules | None = None, **options
) -> DataFrame:
    """Learn a character map from a column (picked by rule), merge it into ``rules`` and write these to ``out``. Returns
    the merged map."""
    rules = rules or readers.Rules()
    text = corpus.pick_column(df, column, -1)
    learned = orthography.learn_char_map(orthography.char_counts(df, text), groups, **options)
    merged = sinks.stage(orthography.merge_char_map(readers.rules_table(df.sparkSession, rules), learned))
    sinks.write_rules(merged, rules, out)
    return merged


def write_variant_files(
    spark: SparkSession, path: str, variants: dict[str, dict[str, str]], out: str, chosen: list[str] | None = None
) -> None:
    """Read ids and texts, spell every text in all variants (or the chosen ones) and write a folder for each."""
    rows = readers.read_id_text(spark, path)
    wanted = {name: variants[name] for name in (chosen or variants)}
    sinks.write_variants(orthography.expand_variants(rows, rows.columns[1], wanted), out)


def audit(
    df: DataFrame, groups: list[list[str]], column: str | None = None, fallback: str | int = -1
) -> tuple[DataFrame, DataFrame]:
    """Character counts with names, and the usage of variants in each group, of a column picked by rule."""
    counts = sinks.stage(orthography.char_counts(df, corpus.pick_column(df, column, fallback)))
    return counts.withColumn("name", T.char_name(F.col("ch"))), orthography.variant_usage(counts, groups)
